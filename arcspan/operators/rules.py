"""Declarative rules: layers, boundaries, budgets, suggestions and gates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import ignored
from ..functions.values import SEPARATOR
from ..session import written
from .graph import live

# The layers from top to bottom.
LAYERS = ("app", "pages", "widgets", "features", "entities", "shared", "core")


def layer(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The first override whose pattern matches, else the first segment after leading ``src`` ones if it is a layer, else ``unknown``."""
    first = F.regexp_extract(path, r"^(?:src/)*([^/]+)(?:/|$)", 1)
    own = F.when(first.isin(*LAYERS), first).otherwise(F.lit("unknown"))
    out = own
    for pattern, name in reversed(list((overrides or {}).items())):
        if pattern and name in LAYERS:
            out = F.when(ignored(path, pattern), F.lit(name)).otherwise(out)
    return out


def rank(name: Column) -> Column:
    """0 for the top layer; -1 for none of them."""
    return F.array_position(F.array(*map(F.lit, LAYERS)), name) - 1


def override_error(pattern: str, name: str) -> str | None:
    return "empty" if not pattern.strip() else "unknown-layer" if name not in LAYERS else None


def layer_violations(modules: DataFrame, edges: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Edges between known modules that lead from a lower layer up; an error from entities or lower to pages or app."""
    at = lambda side: modules.select(F.col("id").alias(side), layer(F.col("id"), overrides).alias(f"{side}_layer"))
    rows = live(edges).where("resolved").join(at("src"), "src").join(at("dst"), "dst").where("src_layer <> 'unknown' AND dst_layer <> 'unknown'")
    a, b = rank(F.col("src_layer")), rank(F.col("dst_layer"))
    return rows.where(a > b).select(F.concat_ws(SEPARATOR, "src", "dst").alias("edge_id"), "ord", "src", "dst", "src_layer", "dst_layer", F.when((b <= 1) & (a >= 4), "error").otherwise("warning").alias("severity"))


@dataclass(frozen=True)
class Boundary:
    name: str
    src: str
    dst: str
    mode: str = "must-not"  # or can-only
    except_: tuple[str, ...] = ()
    cross_instance: bool = False
    severity: str = "error"

    def depth(self) -> int:
        """The segment of the first lone star, if it is the same in both patterns; else -1."""
        at = [next((k for k, s in enumerate(p.split("/")) if s == "*"), -1) for p in (self.src, self.dst)]
        return at[0] if at[0] == at[1] else -1


@dataclass(frozen=True)
class Budget:
    name: str
    module: str
    limits: dict[str, int] = field(default_factory=dict)  # of fan_in, fan_out, loc
    max_cycles: int | None = None
    severity: str = "error"


def _numbered(rows: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """Adds ``id``: kind, rule and a running number of the rule's rows in the order of ``by``.

    A rule may have most of the rows, so none is numbered by one task: rows
    are dealt out by ranges of rule and order, numbered within each range, and
    the counts of the ranges before are added.
    """
    dealt = rows.repartitionByRange("rule", *by).sortWithinPartitions("rule", *by).withColumn("at", F.monotonically_increasing_id())
    fixed = written(dealt, "numbered").withColumn("range", F.shiftright("at", 33))
    before = Window.partitionBy("rule").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = fixed.groupBy("rule", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("at") - F.col("first") + F.col("before")
    return fixed.join(ranges, ["rule", "range"]).withColumn("id", F.concat(F.lit(f"{kind}:"), "rule", F.lit(":"), number.cast("string"))).drop("at", "range", "first", "before")


def boundary_violations(edges: DataFrame, rules: list[Boundary]) -> DataFrame:
    """``id, rule, severity, src, dst, specifier, ord``: one pass over the edges for all rules."""
    hits = []
    for r in rules:
        trips = ignored(F.col("src"), r.src)
        if r.cross_instance and (d := r.depth()) >= 0:
            at = lambda c: F.get(F.split(c, "/"), d)  # noqa: E731, B023
            trips &= ~at("src").eqNullSafe(at("dst"))
        spared = ignored(F.col("dst"), list(r.except_)) if r.except_ else F.lit(False)
        target = ignored(F.col("dst"), r.dst)
        trips &= (target if r.mode == "must-not" else ~target & ~ignored(F.col("dst"), r.src)) & ~spared
        hits.append(F.when(trips, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))))
    rows = live(edges).where("resolved AND src <> dst").withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select("ord", "src", "dst", "specifier", "hit.rule", "hit.severity")
    return _numbered(rows, "boundary", ["ord"]).select("id", "rule", "severity", "src", "dst", "specifier", "ord")


def budget_violations(metrics: DataFrame, members: DataFrame, rules: list[Budget]) -> DataFrame:
    """``id, rule, severity, module, metric, value, limit``; a cycle limit gives one row for a rule."""
    order = {"fan_in": 0, "fan_out": 1, "loc": 2}
    checks = [F.when(ignored(F.col("id"), r.module) & (F.col(c) > n), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(c).alias("metric"), F.col(c).cast("long").alias("value"), F.lit(n).cast("long").alias("limit"), F.lit(order[c]).alias("k"))) for r in rules for c, n in r.limits.items()]
    cols = ["rule", "severity", "module", "metric", "value", "limit", "ord", "k"]
    parts = []
    if checks:
        parts.append(metrics.withColumn("hit", F.explode(F.array_compact(F.array(*checks)))).select("hit.rule", "hit.severity", F.col("id").alias("module"), "hit.metric", "hit.value", "hit.limit", F.col("ord").cast("string").alias("ord"), "hit.k"))
    for r in rules:
        if r.max_cycles is not None:
            n = members.where(ignored(F.col("id"), r.module)).agg(F.count_distinct("comp").alias("value"))
            parts.append(n.where(F.col("value") > r.max_cycles).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.module).alias("module"), F.lit("cycles").alias("metric"), F.col("value").cast("long").alias("value"), F.lit(r.max_cycles).cast("long").alias("limit"), F.lit(None).cast("string").alias("ord"), F.lit(9).alias("k")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p.select(*cols))
    # numbers as text sort like numbers when they are filled up; a cycle limit comes last
    rows = rows.select(*cols).withColumn("ord", F.coalesce(F.lpad("ord", 20, "0"), F.lit("~")))
    return _numbered(rows, "budget", ["ord", "k"]).drop("ord", "k")


def suggestions(modules: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Rules that the present state would keep or that it breaks: ``kind, name, n``."""
    features = modules.select(F.regexp_extract("id", "^src/features/([^/]+)/", 1).alias("f")).where("f <> ''").agg(F.count_distinct("f").alias("n")).where("n >= 2").select(F.lit("boundary").alias("kind"), F.lit("features-isolation").alias("name"), "n")
    pairs = live(edges).select(layer(F.col("src")).alias("a"), layer(F.col("dst")).alias("b")).where((F.col("a") != "unknown") & (F.col("b") != "unknown") & (rank(F.col("a")) > rank(F.col("b")))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    upward = pairs.select(F.lit("boundary").alias("kind"), F.concat(F.lit("layer-"), "a", F.lit("-not-"), "b").alias("name"), "n")
    labels = ("shared", "entities", "core", "shared/ui")
    under = lambda c: F.array_compact(F.array(*(F.when(F.col(c).startswith(f"src/{x}/"), F.lit(x)) for x in labels)))
    there = modules.select(F.explode(under("id")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    broken = members.select(F.explode(under("id")).alias("x")).distinct()
    clean = there.join(broken, "x", "left_anti").select(F.lit("budget").alias("kind"), F.concat(F.lit("no-cycles-"), F.replace("x", F.lit("/"), F.lit("-"))).alias("name"), "n")
    return features.union(upward).union(clean)


# --- gates -------------------------------------------------------------------

GRADES = "ABCDF"
_COUNTED = ("cycles", "layer-violations", "recommendations", "contract-violations", "contract-errors", "new-cycles", "new-layer-violations", "new-contract-violations")
#: Gates on the findings of a severity and above, and the severities they know.
BY_SEVERITY = {"bundle-bloat": ("low", "medium", "high")} | dict.fromkeys(("signals", "new-signals", "regressed-signals"), ("info", "low", "medium", "high", "critical"))


def parse_gate(text: str) -> tuple[str, str, str | int]:
    """``(name, operator, limit)`` of a rule ``name:limit``; the gate fails where the summary goes beyond it.

    ``grade:C`` fails on C and worse; counts fail above the limit, ``any`` from
    1, and after ``>`` or ``>=`` as written; a gate of ``BY_SEVERITY`` fails if
    there is one finding of its severity or above.
    """
    name, sep, value = text.strip().partition(":")
    value = value.strip()
    if not sep:
        raise ValueError(f"a gate is written name:limit, not {text!r}")
    if name == "grade":
        if value.upper() not in GRADES or len(value) != 1:
            raise ValueError(f"no such grade: {value!r}")
        return name, ">=", value.upper()
    if name in BY_SEVERITY:
        if value.lower() not in BY_SEVERITY[name]:
            raise ValueError(f"no such severity: {value!r}")
        return f"{name}-{value.lower()}", ">", 0
    if name not in _COUNTED:
        raise ValueError(f"no such gate: {name!r}")
    m = re.fullmatch(r"(>=|>)?\s*(\d+)|any", value)
    if not m:
        raise ValueError(f"a count is expected, not {value!r}")
    return (name, ">", 0) if value == "any" else (name, m[1] or ">", int(m[2]))


def gates(summary: DataFrame, rules: list[str]) -> DataFrame:
    """For each rule over a one-row summary (a column for each name, ``-`` as ``_``): ``gate, actual, failed``.

    Gates by severity read a column for each, as ``signals_high``: what is as severe or more.
    """
    rows = []
    for text in rules:
        name, op, limit = parse_gate(text)
        c = F.col(name.replace("-", "_"))
        if name == "grade":
            failed = F.instr(F.lit(GRADES), c) >= GRADES.index(limit) + 1
        else:
            failed = c >= limit if op == ">=" else c > limit
        rows.append(F.struct(F.lit(text).alias("gate"), c.cast("string").alias("actual"), failed.alias("failed")))
    return summary.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def budget_state(summary: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Limits on columns of a one-row summary: ``metric, actual, limit, exceeded``."""
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("actual"), F.lit(v).cast("long").alias("limit"), (F.col(k) > v).alias("exceeded")) for k, v in limits.items()]
    return summary.select(F.explode(F.array(*rows)).alias("b")).select("b.*")
