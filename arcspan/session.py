"""What operators need of a session: shared tables and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED = "/tmp/checkpoints/arcspan"

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # on the driver; the executors get it from Spark, which serves it from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on one machine only, it may be unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SHARED


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and lets a costly stage be read several times; a lost
    executor costs only the tasks that it ran. The table lives until the
    Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` for a table that grows with the project: joins merge it, as a small file may hold more rows than a driver."""
    return written(df, name).hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again, and let go of shuffles that are done."""
    import gc

    for df in tables:
        spark = df.sparkSession
        paths = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
        for entry in [x for x in _written if any(p.endswith(x[1].rstrip("/").rpartition("/")[2]) for p in paths)]:
            _written.remove(entry)
            _delete(*entry)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def forget() -> None:
    """Delete the tables of :func:`written`; results read from them must be done."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; the folder's owner clears it
            return
