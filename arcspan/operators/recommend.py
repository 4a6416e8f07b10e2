"""Findings: recommendations, signals, insights and their life across scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_up, short_id
from .graph import live
from .rules import layer

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
KEPT = 20


def _finding(rows: DataFrame, kind: str, id_: Column, modules: Column, weight: Column, order: int, ord_: Column, **params: Column) -> DataFrame:
    """The common shape; ``seq`` orders kinds and what each found, as equal weights have no other order."""
    values = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    listed = F.create_map(*values) if values else F.lit(None).cast("map<string,string>")
    return rows.select(id_.alias("id"), F.lit(kind).alias("kind"), modules.alias("modules"), listed.alias("params"), weight.cast("double").alias("weight"), F.lit(order).alias("stage"), ord_.cast("string").alias("seq"))


def god_modules(metrics: DataFrame, fan_in: int = 8, loc: int = 300) -> DataFrame:
    """Large modules among the most imported: fan-in at the 95th place in a hundred or above.

    The place is the ascending position ``floor(0.95 n)``, found on counts of
    distinct fan-ins.
    """
    counts = metrics.groupBy("fan_in").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("fan_in").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = metrics.agg(F.floor(F.count(F.lit(1)) * 0.95).alias("place"))
    cut = counts.withColumn("upto", upto).crossJoin(total).where("upto > place").agg(F.min("fan_in").alias("cut"))
    rows = metrics.crossJoin(F.broadcast(cut)).where((F.col("fan_in") >= F.col("cut")) & (F.col("fan_in") >= fan_in) & (F.col("loc") >= loc) & ~F.col("is_infra"))
    return _finding(rows, "split-god-module", F.concat(F.lit("god:"), "id"), F.array("id"), F.least(F.lit(1.0), F.col("fan_in") / 30 + F.col("loc") / 1000), 0, F.lpad(F.col("ord").cast("string"), 20, "0"), name=short_id(F.col("id")), fanIn=F.col("fan_in"), loc=F.col("loc"))


def unused_utilities(metrics: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    rows = metrics.where("NOT is_infra AND kind = 'util' AND fan_in = 0")
    if entries is not None:
        rows = rows.join(entries.select("id"), "id", "left_anti")
    return _finding(rows, "unused-utility", F.concat(F.lit("unused:"), "id"), F.array("id"), F.lit(0.4), 1, F.lpad(F.col("ord").cast("string"), 20, "0"), name=short_id(F.col("id")))


def from_type_only(candidates: DataFrame) -> DataFrame:
    """An import that only brings types: the cheapest way out of a cycle. ``candidates``: ``src, dst, specifier, names``."""
    return _finding(
        candidates, "type-only-candidate", F.concat(F.lit("typeonly:"), "src", F.lit("\x01"), "dst"), F.array("src", "dst"), F.lit(0.7), 3,
        F.concat_ws("|", "src", "dst", "specifier"), **{"from": short_id(F.col("src")), "to": short_id(F.col("dst")), "specifier": F.col("specifier"), "bindings": F.replace("names", F.lit(","), F.lit(", "))},
    )


def misplaced(modules: DataFrame, edges: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """Modules that mostly another layer imports; importers of no layer stay in the denominator."""
    counted = live(edges).groupBy(F.col("dst").alias("id"), layer(F.col("src")).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("by") != "unknown", F.struct("n", F.col("by")))).alias("top"))
    rows = modules.where("NOT is_infra").withColumn("own", layer(F.col("id"))).where("own <> 'unknown'").join(best, "id")
    rows = rows.where((F.col("total") >= least) & (F.col("top.by") != F.col("own")) & (F.col("top.n") >= F.col("total") * share))
    return _finding(rows, "misplaced-by-layer", F.concat(F.lit("layer:"), "id"), F.array("id"), 0.5 + 0.3 * (F.col("top.n") / F.col("total")), 4, F.lpad(F.col("ord").cast("string"), 20, "0"), name=short_id(F.col("id")), currentLayer=F.col("own"), targetLayer=F.col("top.by"), majority=F.col("top.n"), total=F.col("total"))


def top_violators(violations: DataFrame, top: int = 3) -> DataFrame:
    counts = violations.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("severity") == "error", 2).otherwise(1)).alias("n"), F.min("ord").alias("ord"))
    rows = counts.orderBy(F.col("n").desc(), "ord").limit(top).where("n >= 2")
    return _finding(rows, "misplaced-by-layer", F.concat(F.lit("vhot:"), "id"), F.array("id"), 0.6 + F.least(F.lit(0.3), F.col("n") / 20), 6, F.col("ord"), name=short_id(F.col("id")), count=F.col("n"), asViolator=F.lit(1))


def from_isolated(clusters: DataFrame) -> DataFrame:
    return _finding(clusters, "isolated-cluster", F.concat(F.lit("isolated:"), "root"), F.array("root"), F.lit(0.45), 5, F.concat(F.lpad(F.col("n").cast("string"), 20, "0"), "root"), count=F.col("n"))


def from_contracts(violations: DataFrame, per_rule: int | None = 20) -> DataFrame:
    """At most ``per_rule`` of each rule, as the report defines; all if None."""
    rows = violations
    if per_rule is not None:
        place = F.row_number().over(Window.partitionBy("rule").orderBy("ord"))
        rows = violations.withColumn("place", place).where(F.col("place") <= per_rule)
    return _finding(rows, "contract-violation", F.concat(F.lit("contract:"), "id"), F.array_compact(F.array("src", "dst")), F.when(F.col("severity") == "error", 0.9).otherwise(0.5), 7, F.concat(F.col("rule"), F.col("ord")), rule=F.col("rule"), severity=F.col("severity"))


def from_coupling(pairs: DataFrame, top: int = 10) -> DataFrame:
    rows = pairs.where("hidden AND cross_boundary").orderBy(F.col("risk").desc(), F.col("score").desc(), F.col("co").desc(), "a", "b").limit(top)
    return _finding(rows, "temporal-coupling", F.concat_ws("|", F.lit("temporal:"), "a", "b"), F.array("a", "b"), 0.5 + F.least(F.lit(0.4), F.col("risk") * 0.45), 8, F.concat_ws("|", (1 - F.col("risk")).cast("string"), "a", "b"), coOccurrences=F.col("co"), score=half_up(F.col("score"), 2))


def from_bundle(kind: str, rows: DataFrame, modules: Column, key: Column) -> DataFrame:
    base = {"duplicate": 0.85, "barrel-leak": 0.8, "heavy-chunk": 0.7}.get(kind, 0.6)
    bump = F.when(F.col("severity") == "high", 0.1).when(F.col("severity") == "medium", 0.05).otherwise(0.0)
    return _finding(rows, "bundle-bloat", F.concat(F.lit(f"bundle:{kind}:"), key), modules, F.least(F.lit(0.95), F.lit(base) + bump), 9, F.concat(F.lit(kind), key), subkind=F.lit(kind), severity=F.col("severity"))


def from_cycles(cycles: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns``: ``comp, pattern, feedback`` (edges against the order)."""
    rows = cycles.join(patterns, "comp")
    base = F.when(F.col("severity") == "direct", 0.85).otherwise(0.6)
    weight = F.when((F.col("pattern") == "hub-feedback") & (F.col("feedback") >= 3), F.least(F.lit(0.95), base + 0.1)).when(F.col("pattern") == "barrel-cycle", F.least(F.lit(0.9), base + 0.05)).otherwise(base)
    return _finding(rows, "cycle-break-cluster", F.concat(F.lit("cycle:"), "comp"), F.col("modules"), weight, 2, F.concat(F.lpad((10**9 - F.col("length")).cast("string"), 20, "0"), "comp"), pattern=F.col("pattern"), severity=F.col("severity"), sccLength=F.col("length"), feedbackCount=F.col("feedback"))


def ranked(parts: list[DataFrame], hot: DataFrame, top: int | None = KEPT) -> DataFrame:
    """The last finding of an id counts; those that touch a hot zone rise by 0.1; the ``top`` by weight stay, all if None."""
    rows = reduce(DataFrame.unionByName, parts)
    last = rows.groupBy("id").agg(F.max_by(F.struct("kind", "modules", "params", "weight", "stage", "seq"), F.struct("stage", "seq")).alias("r")).select("id", "r.*")
    touching = last.select("id", F.explode("modules").alias("m")).join(hot.select(F.col("id").alias("m")), "m", "left_semi").select("id", F.lit(True).alias("touches")).distinct()
    rows = last.join(touching, "id", "left").withColumn("final", F.when(F.col("touches"), F.least(F.lit(1.0), F.col("weight") + 0.1)).otherwise(F.col("weight")))
    if top is not None:
        rows = rows.orderBy(F.col("final").desc(), F.col("weight").desc(), "stage", "seq").limit(top)
    return rows.select("id", "kind", "modules", "params", F.col("final").alias("weight"))


# --- signals -------------------------------------------------------------------


def _cases(by: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(by == k, F.lit(v)).otherwise(out)
    return out


def place(by: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), by)


def score(severity: Column, confidence: Column, maturity: Column, weight: Column, limitations: Column) -> Column:
    """What a signal is worth: severity by confidence, and weight, less noise."""
    noise = F.when(confidence == "low", 22).otherwise(limitations * 3 + _cases(maturity, {"experimental": 12, "beta": 4}, 0))
    return F.greatest(F.lit(0.0), _cases(severity, dict(zip(SEVERITIES, (5, 15, 35, 65, 90))), 0) * _cases(confidence, {"low": 0.55, "medium": 0.8}, 1.0) + F.least(F.lit(20.0), weight) - noise)


def signals(recommendations: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One signal for each recommendation: class, confidence (less where the parser was unsure), score and stable key.

    ``quality`` has ``id, n_approximate, n_low, n_limitations`` of modules of
    which the parser is unsure: one more limitation, and of high confidence no
    more where an import is approximate or of low confidence.
    """
    kind, given = F.col("kind"), F.col("params")["severity"]
    rows = recommendations.withColumns({
        "severity": F.when((kind == "contract-violation") & (given == "error"), "high").when((kind == "bundle-bloat") & (given == "high"), "high").when(kind.isin("contract-violation", "bundle-bloat", "cycle-break-cluster", "type-only-candidate", "temporal-coupling", "misplaced-by-layer"), "medium").otherwise("low"),
        "confidence": F.when(kind.isin("contract-violation", "bundle-bloat", "cycle-break-cluster", "type-only-candidate"), "high").when(kind.isin("temporal-coupling", "misplaced-by-layer"), "medium").otherwise("low"),
        "maturity": F.when(kind.isin("contract-violation", "cycle-break-cluster", "type-only-candidate"), "stable").when(kind.isin("bundle-bloat", "temporal-coupling", "misplaced-by-layer"), "beta").otherwise("experimental"),
        "limitations": F.when(kind.isin("contract-violation", "bundle-bloat", "cycle-break-cluster", "type-only-candidate"), 0).otherwise(1),
    })
    if quality is not None:
        touched = rows.where(~kind.isin("bundle-bloat", "temporal-coupling")).select("id", F.explode("modules").alias("m"))
        doubtful = quality.where("n_approximate > 0 OR n_low > 0 OR n_limitations > 0")
        poor = doubtful.select(F.col("id").alias("m"), (F.expr("n_approximate > 0 OR n_low > 0")).alias("poor"), F.lit(True).alias("unsure"))
        unsure = touched.join(poor, "m").groupBy("id").agg(F.max("poor").alias("poor"), F.max("unsure").alias("unsure"))
        less = F.col("poor") & (F.col("confidence") == "high")
        rows = rows.join(unsure, "id", "left").withColumns({"confidence": F.when(less, "medium").otherwise(F.col("confidence")), "limitations": F.col("limitations") + F.when(F.col("unsure"), 1).otherwise(0)}).drop("unsure", "poor")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), r"\s+", " "))
    key = F.concat_ws(":", kind, F.array_join(F.array_sort(F.array_distinct(F.transform("modules", clean))), ","), F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), clean(e["value"]))), ","))
    return rows.select(F.concat(F.lit("signal:"), "id").alias("id"), key.alias("stable_key"), "kind", "severity", "confidence", "maturity", "modules", score(F.col("severity"), F.col("confidence"), F.col("maturity"), F.col("weight"), F.col("limitations")).alias("score"), F.col("id").alias("recommendation"))


def _observed(rows: DataFrame, id_: Column, key: Column, kind: Column, severity: Column, confidence: Column, weight: Column, limitations: int) -> DataFrame:
    """Signals that no recommendation stands behind; beta all of them."""
    worth = score(severity, confidence, F.lit("beta"), weight, F.lit(limitations))
    return rows.select(id_.alias("id"), key.alias("stable_key"), kind.alias("kind"), severity.alias("severity"), confidence.alias("confidence"), F.lit("beta").alias("maturity"), F.col("modules"), worth.alias("score"), F.lit(None).cast("string").alias("recommendation"))


def from_warnings(warnings: DataFrame) -> DataFrame:
    """A signal for each warning ``code, file, detail``."""
    rows = warnings.distinct().withColumn("modules", F.array_compact(F.array("file")))
    kind = F.concat(F.lit("warning:"), "code")
    key = F.concat_ws(":", kind, F.coalesce("file", F.lit("")), F.coalesce("detail", F.lit("")))
    return _observed(rows, F.concat(F.lit("signal:"), key), key, kind, F.lit("low"), F.lit("medium"), F.lit(1), 0)


def from_lifecycles(risks: DataFrame) -> DataFrame:
    """A signal for each lifecycle risk ``id, risk, kind, line, severity, confidence, message``; its key has no line, so code may move."""
    rows = risks.withColumn("modules", F.array("id"))
    group = F.when(F.col("risk") == "memory-risk", "memory").otherwise("async-lifecycle")
    id_ = F.concat_ws(":", F.lit("signal"), group, F.col("kind"), F.col("id"), F.col("line").cast("string"))
    key = F.concat_ws(":", "risk", "kind", "id", "message")
    return _observed(rows, id_, key, F.col("risk"), F.col("severity"), F.col("confidence"), F.when(F.col("confidence") == "high", 8).otherwise(4), 1)


def all_signals(recommendations: DataFrame, quality: DataFrame, warnings: DataFrame, risks: DataFrame) -> DataFrame:
    """Signals of recommendations, warnings and lifecycle risks."""
    return signals(recommendations, quality).unionByName(from_warnings(warnings)).unionByName(from_lifecycles(risks))


def suppressed_by(rows: DataFrame, suppressions: tuple[dict, ...], now: str) -> DataFrame:
    """Signals with ``suppressed``, by the suppressions of a configuration (``stableKey, module, expires``)."""
    if not suppressions:
        return rows.withColumn("suppressed", F.lit(False))
    table = [(x["stableKey"], x.get("module"), x.get("expires")) for x in suppressions]
    return suppress(rows, rows.sparkSession.createDataFrame(table, "stable_key string, module string, expires string"), now)


def can_fail_ci(least: str = "high", beta: bool = False) -> Column:
    """Unsuppressed, unresolved, of high confidence, severe enough and mature."""
    mature = F.col("maturity").isin("stable", "beta") if beta else F.col("maturity") == "stable"
    return ~F.col("suppressed") & (F.col("status") != "resolved") & (F.col("confidence") == "high") & (place(F.col("severity"), SEVERITIES) >= SEVERITIES.index(least) + 1) & mature


def suppress(rows: DataFrame, suppressions: DataFrame, now: str) -> DataFrame:
    """Adds ``suppressed``; a suppression ``(stable_key, module, expires)`` ends at its date and may name a module."""
    active = suppressions.where(F.col("expires").isNull() | (F.col("expires") > now)).select(F.col("stable_key").alias("k"), "module")
    hit = rows.join(active, (F.col("stable_key") == F.col("k")) & (F.col("module").isNull() | F.array_contains("modules", F.col("module"))), "left_semi").select("id", F.lit(True).alias("suppressed")).distinct()
    return rows.join(hit, "id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def stale(suppressions: DataFrame, rows: DataFrame) -> DataFrame:
    return suppressions.join(rows.select("stable_key").distinct(), "stable_key", "left_anti")


def lifecycle(before: DataFrame, after: DataFrame) -> DataFrame:
    """``stable_key, status``: new, existing, regressed (more severe or surer) or resolved."""
    at = lambda df, p: df.select("stable_key", place(F.col("severity"), SEVERITIES).alias(f"{p}_s"), place(F.col("confidence"), CONFIDENCES).alias(f"{p}_c")).groupBy("stable_key").agg(F.max(f"{p}_s").alias(f"{p}_s"), F.max(f"{p}_c").alias(f"{p}_c"))
    both = at(before, "old").join(at(after, "new"), "stable_key", "full")
    status = F.when(F.col("old_s").isNull(), "new").when(F.col("new_s").isNull(), "resolved").when((F.col("new_s") > F.col("old_s")) | (F.col("new_c") > F.col("old_c")), "regressed").otherwise("existing")
    return both.select("stable_key", status.alias("status"))


def insights(rows: DataFrame, top: int = 8) -> DataFrame:
    """Signals by their first module: how many, the highest severity, the lowest confidence, the sum of scores."""
    grouped = rows.withColumn("module", F.element_at("modules", 1)).groupBy("module").agg(F.count(F.lit(1)).alias("n_signals"), F.max(place(F.col("severity"), SEVERITIES)).alias("s"), F.min(place(F.col("confidence"), CONFIDENCES)).alias("c"), half_up(F.sum("score")).alias("score"))
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int"))
    return grouped.orderBy(F.col("score").desc(), "module").limit(top).select("module", "n_signals", pick(SEVERITIES, "s").alias("severity"), pick(CONFIDENCES, "c").alias("confidence"), "score")
