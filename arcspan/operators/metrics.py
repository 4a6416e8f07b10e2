"""Metrics of modules and of the whole: fan, coupling, hotness, hot zones, debt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_up, saturate
from .graph import live


def fans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``modules`` with ``fan_in, fan_out``: parallel edges count each.

    Both ends of an edge go through one pre-aggregated shuffle.
    """
    ends = live(edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return modules.join(counted, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("fan_in", "fan_out")})


def module_metrics(modules: DataFrame, edges: DataFrame, members: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """``modules`` with fan-in and -out, ``instability, in_cycle, coupling, hotness`` (and ``depth``).

    The two maxima are one row, joined to all.
    """
    m = fans(modules, edges).join(members.select("id", F.lit(True).alias("in_cycle")), "id", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    raw = F.log2(F.col("fan_in") + 1) * F.log2(F.col("fan_out") + 1)
    m = m.withColumn("raw", raw)
    top = m.agg(F.max("raw").alias("top_raw"), F.max("loc").alias("top_loc"))
    m = m.crossJoin(F.broadcast(top))  # one row
    coupling = F.when(F.col("top_raw") == 0, F.lit(0.0)).otherwise(F.col("raw") / F.col("top_raw"))
    size = F.when(F.col("top_loc") == 0, F.lit(1.0)).otherwise(1 + F.log2(1 + F.col("loc")) / F.log2(1 + F.col("top_loc")))
    both = F.col("fan_in") + F.col("fan_out")
    m = m.withColumns({
        "instability": half_up(F.when(both == 0, F.lit(0.0)).otherwise(F.col("fan_out") / both)),
        "coupling": half_up(coupling),
        "hotness": half_up(coupling * F.when(F.col("in_cycle"), 1.5).otherwise(1.0) * size),
    }).drop("raw", "top_raw", "top_loc")
    return m if depth is None else m.join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def is_barrel(fan_out: int = 3, surface: int = 5, loc_each: int = 4) -> Column:
    """A file that mostly passes on others: several imports, little code for what it offers."""
    offered = F.greatest("fan_out", "n_exports")
    return (F.col("fan_out") >= fan_out) & (offered >= surface) & (F.col("loc") < loc_each * offered)


def hot_zones(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` modules by hotness, of which barrels are then left out (no others move up)."""
    best = metrics.where("NOT is_infra AND hotness > 0").orderBy(F.col("hotness").desc(), "id").limit(top)
    return best.where(~is_barrel()).select("id", "hotness")


def arch_debt(metrics: DataFrame, cycles: DataFrame, violations: DataFrame, hot: DataFrame) -> DataFrame:
    """One row: score (0 to 100), grade and its four parts; each input is first a single row."""
    real = metrics.where("NOT is_infra").agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"), F.coalesce(F.avg("instability"), F.lit(0.0)).alias("inst"))
    rings = cycles.agg(F.coalesce(F.sum(F.when(F.col("severity") == "direct", 2).otherwise(1)), F.lit(0)).alias("rings"))
    bad = violations.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", 3).otherwise(1)), F.lit(0)).alias("bad"))
    hots = hot.agg(F.count(F.lit(1)).alias("hots"))
    one = real.crossJoin(rings).crossJoin(bad).crossJoin(hots)
    one = one.withColumns({
        "c": saturate(F.col("rings") / F.greatest(F.lit(1.0), F.col("n") * 0.05)),
        "l": saturate(F.col("bad") / F.greatest(F.lit(1.0), F.col("n") * 0.03)),
        "h": saturate(F.col("hots") * 10 / F.col("n")),
    })
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (F.col("c") * 0.35 + F.col("l") * 0.3 + F.col("h") * 0.15 + F.col("inst") * 0.2)))
    whole = lambda x: half_up(x, 0).cast("long")
    grade = F.when(score < 15, "A").when(score < 30, "B").when(score < 50, "C").when(score < 70, "D").otherwise("F")
    return one.select(whole(score).alias("score"), grade.alias("grade"), whole(F.col("c") * 100).alias("cycles"), whole(F.col("l") * 100).alias("layer_violations"), whole(F.col("h") * 100).alias("hot_zones"), whole(F.col("inst") * 100).alias("coupling"))


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's coefficient, ties at their average rank.

    Ranks come from the distinct values with their counts, so the windows see
    values, not rows.
    """

    def ranks(c: str) -> DataFrame:
        counted = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counted.select(c, (upto - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    ranked = rows.join(ranks(a), a).join(ranks(b), b)
    return ranked.agg(F.count(F.lit(1)).alias("n"), half_up(F.corr(f"rank_{a}", f"rank_{b}")).alias("rho"))


def accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of findings ``(kind, id, module)``: a finding is right if an expected one of its kind shares a module."""
    pair = found.select("kind", F.col("id").alias("f"), "module").join(expected.select("kind", F.col("id").alias("e"), "module"), ["kind", "module"])
    one = found.agg(F.count_distinct("kind", "id").alias("n_found")).crossJoin(expected.agg(F.count_distinct("kind", "id").alias("n_expected"))).crossJoin(pair.agg(F.count_distinct("kind", "f").alias("tp"), F.count_distinct("kind", "e").alias("hit")))
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    p, r = share("tp", "n_found"), share("hit", "n_expected")
    return one.select("tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_expected") - F.col("hit")).alias("fn"), half_up(p).alias("precision"), half_up(r).alias("recall"), half_up(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))).alias("f1"))


def extensions(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.groupBy(F.regexp_extract(path, r"(\.[^./]+)$", 1).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def parser_quality(imports: DataFrame) -> DataFrame:
    """Per module: imports, approximate ones, those of low confidence, and the level of trust that follows."""
    out = imports.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("approximate")).alias("n_approximate"), F.count_if(F.col("confidence") == "low").alias("n_low"))
    level = F.when(F.col("n_low") > 0, "low").when(F.col("n_approximate") > 0, "medium").otherwise("high")
    return out.withColumn("quality", level)


def counts_by(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts for every value of a domain, zeros included."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
