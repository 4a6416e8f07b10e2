"""Value semantics that decide whether results are equal."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = "\u0001"


def half_up(x: Column, digits: int = 3) -> Column:
    """Rounds a double as scripting languages do: halves go up, in binary."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def saturate(x: Column) -> Column:
    return 1 - 1 / (1 + F.greatest(x, F.lit(0.0)))


def short_id(path: Column) -> Column:
    """The last three segments of a longer path, after an ellipsis."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 3, path).otherwise(F.concat(F.lit("…/"), F.array_join(F.slice(parts, -3, 3), "/")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def fnv1a(text: str) -> str:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h ^ (units[k] | units[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def cycle_id(members: Column) -> Column:
    """The stable id of a set of modules: their sorted, joined names hashed, for a whole batch at a time."""

    @F.arrow_udf(StringType())
    def named(joined: pa.Array) -> pa.Array:
        return pa.array([f"cycle:{fnv1a(t)}" for t in joined.to_pylist()])

    return named(F.array_join(F.array_sort(members), SEPARATOR))
