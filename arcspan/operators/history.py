"""Change history: churn of modules and pairs that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_up

TOP_AUTHORS, OTHERS = 5, "__other__"


def touched(modules: DataFrame, changes: DataFrame) -> DataFrame:
    """``sha, id, lines``: modules a commit touches under either name, lines once for each change."""
    named = F.array_distinct(F.array_compact(F.array("path", "renamed_from"))) if "renamed_from" in changes.columns else F.array("path")
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))
    rows = changes.select("sha", F.explode(named).alias("id"), lines.alias("lines")).join(modules.select("id").distinct(), "id", "left_semi")
    return rows.groupBy("sha", "id").agg(F.sum("lines").alias("lines"))


def churn(modules: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per touched module: commits, lines, authors (exact), the last day, and the top authors with the rest as one.

    Authors are counted per (module, author) first; the window that ranks them
    sees these counts.
    """
    rows = touched(modules, changes).join(commits, "sha")
    by = rows.groupBy("id", "author").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.max("authored_at").alias("last"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "author"))
    name = F.when(F.col("place") <= TOP_AUTHORS, F.col("author")).otherwise(F.lit(OTHERS))
    top = by.withColumn("place", place).groupBy("id", F.least("place", F.lit(TOP_AUTHORS + 1)).alias("place"), name.alias("author")).agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.max("last").alias("last"), F.count(F.lit(1)).alias("people"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "author", "n"))), lambda x: F.concat(x["author"], F.lit("="), x["n"].cast("string")))
    return top.groupBy("id").agg(F.sum("n").alias("commits"), F.sum("lines").alias("lines_changed"), F.sum("people").alias("author_count"), F.max("last").alias("last_touched_at"), F.array_join(listed, ",").alias("authors"))


def boundary(path: Column) -> Column:
    """The first folder below ``src/``; empty for files without one."""
    return F.regexp_extract(path, r"^(?:src/)?([^/]+)/", 1)


def temporal_coupling(modules: DataFrame, edges: DataFrame, changes: DataFrame, min_co: int = 3, min_score: float = 0.5, max_pairs: int = 100, fan_out_cap: int = 30) -> DataFrame:
    """Pairs that change in the same commits, by risk.

    Commits that touch over ``fan_out_cap`` modules say nothing and are left
    out, as the operator defines, which also bounds the pairs of a commit.
    """
    named = F.array_distinct(F.array_compact(F.array("path", "renamed_from"))) if "renamed_from" in changes.columns else F.array("path")
    rows = changes.select("sha", F.explode(named).alias("id")).join(modules.select("id").distinct(), "id", "left_semi").distinct()
    small = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= fan_out_cap).select("sha")  # before sets are built
    sets = rows.join(small, "sha").groupBy("sha").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    alone = sets.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    after = lambda ids: F.flatten(F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, F.size(ids)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = sets.select(F.explode(after(F.col("ids"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("co")).where(F.col("co") >= min_co)
    pairs = pairs.join(alone.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(alone.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    static = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("known")).distinct()
    pairs = pairs.withColumns({"score_a": F.col("co") / F.col("n_a"), "score_b": F.col("co") / F.col("n_b")}).withColumn("score", F.least("score_a", "score_b")).where(F.col("score") >= min_score)
    pairs = pairs.join(static, ["a", "b"], "left").withColumns({"hidden": F.col("known").isNull(), "cross_boundary": boundary(F.col("a")) != boundary(F.col("b"))})
    risk = F.col("score") * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("co") / 10)) * F.when(F.col("hidden"), 1.25).otherwise(0.6) * F.when(F.col("hidden") & F.col("cross_boundary"), 1.15).otherwise(1.0)
    pairs = pairs.withColumn("risk", F.least(F.lit(1.0), half_up(risk)))
    return pairs.orderBy(F.col("risk").desc(), F.col("score").desc(), F.col("co").desc(), "a", "b").limit(max_pairs).select("a", "b", "co", half_up(F.col("score_a"), 6).alias("score_a"), half_up(F.col("score_b"), 6).alias("score_b"), half_up(F.col("score"), 6).alias("score"), "hidden", "cross_boundary", "risk")
