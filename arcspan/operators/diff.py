"""Two scans side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modules(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, change``: added, removed, or changed in kind, size or language."""
    tracked = ("kind", "loc", "language")
    a = before.select("id", F.struct(*tracked).alias("old"))
    b = after.select("id", F.struct(*tracked).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change IS NOT NULL")


def keyed(before: DataFrame, after: DataFrame, key: str, what: str) -> DataFrame:
    """``key, change``: what is new and what is resolved, by a key; repeats collapse."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    new = b.join(a, key, "left_anti").select(F.lit(what).alias("what"), F.col(key).alias("key"), F.lit("new").alias("change"))
    return new.union(a.join(b, key, "left_anti").select(F.lit(what), F.col(key), F.lit("resolved")))


def manifest(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` of files by modification time and size."""
    a = before.select("path", F.struct("mtime", "size").alias("old"))
    b = after.select("path", F.struct("mtime", "size").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("what", "change").agg(F.count(F.lit(1)).alias("n"))


def edge_recall(own: DataFrame, other: DataFrame) -> DataFrame:
    """Edges both graphs could have (both files known to both): ``n_other, n_missed, n_extra``."""
    nodes = lambda e: e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    common = nodes(own).join(nodes(other), "id", "left_semi")
    inside = lambda e: e.select("src", "dst").distinct().join(common.withColumnRenamed("id", "src"), "src", "left_semi").join(common.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    a, b = inside(own), inside(other)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(b, "n_other").crossJoin(n(b.join(a, ["src", "dst"], "left_anti"), "n_missed")).crossJoin(n(a.join(b, ["src", "dst"], "left_anti"), "n_extra"))


def trend(row: DataFrame) -> DataFrame:
    """Direction from weighted regressions and improvements, with a dead band of five.

    Takes one row: ``score_delta, new_cycles, resolved_cycles, new_signals, regressed_signals, resolved_signals``.
    """
    worse = F.greatest(F.lit(0), "score_delta") + F.col("new_cycles") * 12 + F.col("regressed_signals") * 10 + F.col("new_signals") * 4
    better = F.greatest(F.lit(0), -F.col("score_delta")) + F.col("resolved_cycles") * 8 + F.col("resolved_signals") * 3
    direction = F.when(worse > better + 5, "regressed").when(better > worse + 5, "improved").otherwise("stable")
    return row.select(worse.cast("long").alias("worse"), better.cast("long").alias("better"), direction.alias("direction"))
