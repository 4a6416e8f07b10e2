"""Findings of all kinds in one list, triage, and projections between signals and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recommend import SEVERITIES, place

BETA = ("temporal-coupling", "bundle", "lifecycle")


def hot_severity(hot: DataFrame) -> DataFrame:
    """Hot zones ``id, severity``: the first third by hotness is high, the rest medium."""
    rank = F.row_number().over(Window.orderBy(F.col("hotness").desc(), "id"))  # a few rows
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return hot.select("id", F.when(rank <= F.ceil(total / 3), "high").otherwise("medium").alias("severity"))


def union(cycles: DataFrame, violations: DataFrame, contracts: DataFrame, hot: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``id, type, severity, modules, beta`` over everything a scan found."""
    mapped = lambda c, table, other: reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), table.items(), F.lit(other))
    level = {"error": "high", "warning": "medium"}
    parts = [
        cycles.select(F.concat(F.lit("cycle:"), "comp").alias("id"), F.lit("cycle").alias("type"), mapped(F.col("severity"), {"direct": "high"}, "medium").alias("severity"), "modules"),
        violations.select(F.concat(F.lit("layer:"), "edge_id", F.lit(":"), "ord").alias("id"), F.lit("layer").alias("type"), mapped(F.col("severity"), level, "low").alias("severity"), F.array("src", "dst").alias("modules")),
        contracts.select(F.concat(F.lit("contract:"), "id").alias("id"), F.lit("contract").alias("type"), mapped(F.col("severity"), level, "low").alias("severity"), F.array("src", "dst").alias("modules")),
        hot_severity(hot).select(F.concat(F.lit("hot:"), "id").alias("id"), F.lit("hot-zone").alias("type"), "severity", F.array("id").alias("modules")),
        recommendations.where("kind NOT IN ('cycle-break-cluster', 'contract-violation')").select(F.concat(F.lit("rec:"), "id").alias("id"), F.col("kind").alias("type"), F.when(F.col("weight") >= 0.8, "high").when(F.col("weight") >= 0.5, "medium").otherwise("low").alias("severity"), "modules"),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("beta", F.col("type").isin(*BETA))


def triaged(findings: DataFrame, types: list[str] | None = None, least: str = "low", beta: bool = True, text: str = "") -> DataFrame:
    keep: Column = place(F.col("severity"), SEVERITIES) >= SEVERITIES.index(least) + 1
    if types:
        keep &= F.col("type").isin(*types)
    if not beta:
        keep &= ~F.col("beta")
    if text:
        keep &= F.exists("modules", lambda m: F.contains(F.lower(m), F.lit(text.lower())))
    return findings.where(keep)


def in_change_set(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Adds ``in_change_set``: a module of the finding changed."""
    hit = findings.select("id", F.explode("modules").alias("m")).join(changed.select(F.col("id").alias("m")), "m", "left_semi").select("id", F.lit(True).alias("in_change_set")).distinct()
    return findings.join(hit, "id", "left").withColumn("in_change_set", F.coalesce("in_change_set", F.lit(False)))


def counts(findings: DataFrame) -> DataFrame:
    """Types by severity, one column each, zeros included."""
    return findings.groupBy("type").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def unsuppressed(recommendations: DataFrame, signals: DataFrame) -> DataFrame:
    """Recommendations whose signal is not suppressed."""
    muted = signals.where("suppressed").select(F.col("recommendation").alias("id"))
    return recommendations.join(muted, "id", "left_anti")


def probed_types(texts: DataFrame, edges: DataFrame, members: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``src, dst, specifier, names``: the imports inside cycles, with the names of those all of whose uses are types, else ''.

    Reads ``texts`` (``id, content``) of files with such an edge alone, each
    once for all its edges (see :mod:`..sources.typeuse` for what counts). What
    ``before`` says isn't read again.
    """
    import pyarrow as pa

    from ..sources.typeuse import type_only_names
    from .graph import cycle_edges

    keys = ["src", "dst", "specifier"]
    inner = cycle_edges(edges, members).where("src <> dst").select(*keys)
    asked = inner if before is None else inner.join(before.select(*keys), keys, "left_anti")
    rows = asked.groupBy("src").agg(F.collect_set(F.struct("dst", "specifier")).alias("imports"))
    rows = rows.join(texts.select(F.col("id").alias("src"), "content"), "src").select("src", "content", "imports")
    columns = (*keys, "names")

    def run(batches):
        for b in batches:
            found = []
            for src, text, imports in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = {x: type_only_names(src, text or "", x) for x in {i["specifier"] for i in imports}}
                found += [(src, i["dst"], i["specifier"], ",".join(names[i["specifier"]])) for i in imports]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(4)], names=list(columns))

    out = rows.mapInArrow(run, ", ".join(f"{c} string" for c in columns))
    return out if before is None else before.join(inner, keys, "left_semi").select(*columns).union(out)


def type_only_candidates(texts: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """The imports inside cycles that only bring types."""
    return probed_types(texts, edges, members).where("names <> ''")
