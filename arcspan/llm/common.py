"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, written

__all__ = ["as_bytes", "by_batch", "dropped", "held_out", "known_labels", "table", "trimmed", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Long texts make large batches, of which a task has several copies (JVM, Arrow, Python).
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23


def held_out(key: str, folds: int, fold: int) -> Column:
    """The column that tells the rows no label may be learnt from: crc32 of the key as text, mod ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def known_labels(labels: DataFrame, column: str, key: str, folds: int, fold: int) -> DataFrame:
    """``(key, y)`` of the rows that may be learnt from; a key whose labels contradict each other, or a null, is none of them."""
    usable = labels.where(F.col(column).isin(0, 1)).where(~held_out(key, folds, fold)).where(F.col(key).isNotNull())
    agreed = usable.groupBy(key).agg(F.min(column).cast("int").alias("y"), F.max(column).cast("int").alias("other"))
    return agreed.where("y = other").select(key, "y")


def as_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts of a string column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def trimmed() -> None:
    """Give freed memory back: idle Python workers stay and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_held: list[tuple[object, object]] = []


def held(key: object, make: Callable[[], object]) -> object:
    """The one large object a Python worker keeps between batches and tasks; another key's takes its place.

    ``key`` is compared by identity and held, so another one can't take its place unseen.
    """
    if not _held or _held[0][0] is not key:
        _held.clear()
        trimmed()
        _held.append((key, make()))
    return _held[0][1]


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch; the session's batches are held to ``BATCH_BYTES``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
            del out, batch
            trimmed()

    return df.mapInArrow(run, schema)
