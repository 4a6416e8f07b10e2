"""Views over a scan: matrix, impact, ownership, surface, hygiene, risk, folders, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_up

from ..operators.recommend import CONFIDENCES, place
from ..operators.rules import layer
from ..session import written

# Folders that hold one folder per domain.
DOMAIN_ROOTS = ("domains", "entities", "features", "mfes", "modules", "pages", "services", "shared", "widgets")
_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|vue|svelte)$"


def is_review(path: Column) -> Column:
    """Not a fixture, mock or test."""
    return ~path.rlike(r"(^|/)(fixtures|test/fixtures|__fixtures__|__tests__|__mocks__)(/|$)|\.(test|spec)\.")


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def area(path: Column) -> Column:
    """The domain a file belongs to, from its folders."""
    package = F.regexp_extract(path, r"(?:^|/)(packages/[^/]+)", 1)
    app = F.regexp_extract(path, r"(?:^|/)(apps/[^/]+)", 1)
    scope = F.split(F.regexp_replace(path, r"^(?:.*?/)?src/", ""), "/")
    first, second = F.get(scope, F.lit(0)), F.get(scope, F.lit(1))
    entry = first.rlike(r"^(main|index|app|App|entry)" + _FILE)
    nested = first.isin(*DOMAIN_ROOTS) & second.isNotNull() & ~F.coalesce(second, F.lit("")).rlike(_FILE)
    return F.when(package != "", package).when(app != "", app).when(first == "", "project").when(entry, "app").when(nested, F.concat(first, F.lit("/"), second)).otherwise(F.regexp_replace(first, _FILE, ""))


def owner(path: Column) -> Column:
    inside = F.regexp_extract(path, r"(?:^|/)(src/[^/]+/[^/]+)", 1)
    return F.when((inside != "") & ~inside.rlike(_FILE), inside).when(path.rlike(r"(^|/)src/"), "src").otherwise(F.array_join(F.slice(F.split(path, "/"), 1, 2), "/"))


def package(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?:^|/)((?:packages|apps)/[^/]+)", 1)
    return F.when(found != "", found).otherwise(folder(path))


GROUPINGS = {"area": area, "layer": layer, "folder": folder, "package": package, "owner": owner}


def at_depth(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(folder(path), "/"), 1, depth), "/")


def matrix(edges: DataFrame, members: DataFrame, violations: DataFrame, grouping: str = "area", only: str | None = None, top: int | None = None) -> DataFrame:
    """Imports, violations and cycle edges from group to group; edges of every kind count."""
    by = GROUPINGS[grouping]
    at = lambda side: members.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    bad = violations.select("src", "dst", F.lit(1).alias("bad")).distinct()
    rows = edges.where("resolved").join(at("src"), "src", "left").join(at("dst"), "dst", "left").join(bad, ["src", "dst"], "left")
    rows = rows.select(by(F.col("src")).alias("from_group"), by(F.col("dst")).alias("to_group"), F.coalesce("bad", F.lit(0)).alias("bad"), F.when(F.col("src_comp") == F.col("dst_comp"), 1).otherwise(0).alias("ring")).where("from_group <> to_group")
    cells = rows.groupBy("from_group", "to_group").agg(F.count(F.lit(1)).alias("imports"), F.sum("bad").alias("violations"), F.sum("ring").alias("cycle_edges"))
    if only:
        cells = cells.where(F.col(only) > 0)
    if top is None:
        return cells
    return cells.orderBy((F.col("violations") * 1000 + F.col("cycle_edges") * 100 + F.col("imports")).desc(), "from_group", "to_group").limit(top)


def impact(target: DataFrame, importers: DataFrame, members: DataFrame, violations: DataFrame) -> DataFrame:
    """Per target: modules that import it over any number of steps, its own cycles and layer violations, and the risk of a change.

    ``importers`` has pairs ``source, id`` or, for many targets, counts ``source, affected``.
    """
    source = F.col("id").alias("source")
    counted = "affected" in importers.columns
    n = importers.select("source", "affected") if counted else importers.where("id <> source").groupBy("source").agg(F.count_distinct("id").alias("affected"))
    rings = members.groupBy(source).agg(F.count_distinct("comp").alias("cycles"))
    bad = violations.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy(source).agg(F.count(F.lit(1)).alias("violations"))
    rows = target.select(source).join(n, "source", "left").join(rings, "source", "left").join(bad, "source", "left").na.fill(0)
    risk = F.when((F.col("cycles") > 0) | (F.col("violations") > 1) | (F.col("affected") >= 10), "high").when((F.col("violations") > 0) | (F.col("affected") >= 3), "medium").otherwise("low")
    return rows.withColumn("risk", risk)


def finding_modules(hot: DataFrame, members: DataFrame, *violations: DataFrame) -> DataFrame:
    """Distinct modules of hot zones, cycles, and both ends of layer and contract violations."""
    ends = [v.select(F.explode(F.array("src", "dst")).alias("id")) for v in violations]
    return reduce(DataFrame.union, [hot.select("id"), members.select("id"), *ends]).where("id IS NOT NULL").distinct()


def ownership(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Per area: modules, findings, risk, the kind that marks it, and whether its findings drift (three modules, 30 %)."""
    rows = metrics.where(is_review(F.col("id"))).withColumn("area", area(F.col("id"))).join(findings.select("id", F.lit(1).alias("hit")), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    risk = F.sum(F.col("hotness") + F.col("coupling") + F.col("fan_in") + F.col("fan_out") + F.col("hit") * 10)
    last = F.max_by(F.when(F.col("kind") != "module", F.col("kind")), F.when(F.col("kind") != "module", F.col("ord")))
    out = rows.groupBy("area").agg(F.count(F.lit(1)).alias("modules"), F.sum("hit").alias("findings"), half_up(risk).alias("risk"), F.coalesce(last, F.lit("module")).alias("primary_kind"))
    return out.withColumn("drift", (F.col("modules") >= 3) & (F.col("findings") / F.col("modules") >= 0.3))


def semantic_surface(metrics: DataFrame, top: int = 20, exports: int = 8) -> DataFrame:
    """``list, id, n_exports, risk``: broad public modules, exports nobody imports, clusters of types."""
    m = metrics.where(~F.col("is_infra") & is_review(F.col("id"))).withColumn("risk", F.col("n_exports") * 2 + F.col("fan_in") * 3 + F.col("fan_out"))
    pick = lambda name, where, *order: m.where(where).orderBy(*order, "id").limit(top).select(F.lit(name).alias("list"), "id", "n_exports", "risk")
    broad = (F.col("n_exports") >= exports) | ((F.col("n_exports") >= exports // 2) & (F.col("fan_in") >= 4))
    quiet = (F.col("n_exports") > 0) & (F.col("fan_in") == 0) & ~F.col("kind").isin("entry", "test")
    types = (F.col("kind") == "schema") | F.col("id").rlike(r"(^|/)(types?|schemas?|models?)(/|\.)")
    return pick("broad", broad, F.col("risk").desc()).union(pick("quiet", quiet, F.col("n_exports").desc())).union(pick("types", types, F.col("risk").desc()))


def dead_code(metrics: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Modules without imports, importers or exports, generated ones left out: ``id, loc, kind, group``."""
    if generated is not None:
        metrics = metrics.join(generated.select("id"), "id", "left_anti")
    rows = metrics.where(is_review(F.col("id")) & (F.col("fan_in") + F.col("fan_out") + F.col("n_exports") == 0) & ~F.col("kind").isin("entry", "test") & ~F.col("is_infra"))
    script = F.col("id").rlike(r"(^|/)scripts/.+\.(js|cjs|mjs)$")
    return rows.select("id", "loc", "kind", F.when(script, "script-entry").otherwise("isolated").alias("group"))


def module_risk(metrics: DataFrame, members: DataFrame, violations: DataFrame, contracts: DataFrame, hot: DataFrame) -> DataFrame:
    """``metrics`` with ``cycle_count, violation_count, risk``; violations are those of layers, at each end, and of contracts, once a module."""
    rings = members.groupBy("id").agg(F.count_distinct("comp").alias("cycle_count"))
    ends = violations.select(F.explode(F.array("src", "dst")).alias("id")).union(contracts.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")))
    bad = ends.groupBy("id").agg(F.count(F.lit(1)).alias("violation_count"))
    rows = metrics.join(rings, "id", "left").join(bad, "id", "left").join(hot.select("id", F.lit(1).alias("is_hot")), "id", "left").na.fill(0, ["cycle_count", "violation_count", "is_hot"])
    return rows.withColumn("risk", half_up(F.col("hotness") + F.col("coupling") + F.col("fan_in") + F.col("fan_out") + F.col("cycle_count") * 12 + F.col("violation_count") * 10 + F.col("is_hot") * 10))


def rolled_up(risks: DataFrame, by: str, top: int = 8) -> DataFrame:
    """Areas, folders or layers with the most risk: modules, lines, risk."""
    rows = risks.groupBy(GROUPINGS[by](F.col("id")).alias("name")).agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), F.sum("cycle_count").alias("cycles"), half_up(F.sum("risk")).alias("risk"))
    return rows.orderBy(F.col("risk").desc(), "name").limit(top).select(F.lit(by).alias("by"), "name", "modules", "loc", "cycles", "risk")


def overview(risks: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [rolled_up(risks, by) for by in ("area", "folder", "layer")])


def folder_explorer(risks: DataFrame, depth: int = 3, each: int = 5) -> DataFrame:
    """Folders at a depth: modules, lines, the sum of their ``each`` highest risks, the worst module."""
    at = at_depth(F.col("id"), depth)
    ranked = risks.withColumn("folder", at).withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("risk").desc(), "id")))
    return ranked.groupBy("folder").agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), half_up(F.sum(F.when(F.col("place") <= each, F.col("risk")))).alias("top_risk"), F.min_by("id", "place").alias("worst"))


def cycles_model(cycles: DataFrame, members: DataFrame, risks: DataFrame) -> DataFrame:
    """Cycles with areas they span, whether they cross them, and the sum of risks."""
    per = members.join(risks.select("id", "risk"), "id").groupBy("comp").agg(F.count_distinct(area(F.col("id"))).alias("n_areas"), half_up(F.sum("risk")).alias("risk"))
    return cycles.join(per, "comp").select(F.array_join("modules", ",").alias("modules"), "length", "severity", "n_areas", (F.col("n_areas") > 1).alias("crosses"), "risk")


def rules_model(layers: DataFrame, contracts: DataFrame) -> DataFrame:
    """Layer and contract findings in one list with counts by rule and severity."""
    a = layers.select(F.concat(F.lit("layer:"), "src_layer", F.lit(">"), "dst_layer").alias("rule"), "severity", "src")
    b = contracts.select(F.concat(F.lit("contract:"), "rule").alias("rule"), "severity", "src")
    return a.union(b).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_modules"))


#: A review's figures that need an older scan.
BASELINE = ("new_cycles", "resolved_cycles", "new_signals", "regressed_signals", "resolved_signals")


def review_parts(debt: DataFrame, cycles: DataFrame, violations: DataFrame, contracts: DataFrame, signals: DataFrame, hot: DataFrame, owners: DataFrame, risks: DataFrame, baseline: dict[str, int] | None = None) -> DataFrame:
    """One row for :func:`review_risk`: what concerns modules that a review looks at.

    ``signals`` are those that may fail a build at ``high``; ``owners`` and ``risks`` hold an ``id`` of modules with
    side effects that need a review, and of memory and asynchronous risks.
    """
    some = lambda ids: F.exists(ids, is_review)
    ends = F.array("src", "dst")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        n(cycles.where(some(F.col("modules")) & (F.col("severity") == "direct")), "direct_cycles"), n(violations.where(is_review(F.col("src")) & is_review(F.col("dst")) & (F.col("severity") == "error")), "layer_errors"),
        n(contracts.where(some(ends) & (F.col("severity") == "error")), "contract_errors"), n(signals.where(some(F.col("modules"))), "ci_signals"), n(hot.where(is_review(F.col("id"))), "hot_zones"),
        n(owners.where(is_review(F.col("id"))), "lifecycle_owners"), n(risks, "lifecycle_risks"),
    ]
    one = reduce(DataFrame.crossJoin, [debt.select("debt"), *parts])  # one row each
    return one.withColumns({c: F.lit((baseline or {}).get(c, 0)) for c in BASELINE})


def review_risk(parts: DataFrame) -> DataFrame:
    """Score and level from a row ``debt, direct_cycles, layer_errors, contract_errors, ci_signals, hot_zones, lifecycle_owners, lifecycle_risks, new_cycles, resolved_cycles, new_signals, regressed_signals, resolved_signals``.

    :func:`review_parts` counts them; without a baseline the last five are 0.
    """
    c = F.col
    raw = c("debt") + c("direct_cycles") * 12 + c("layer_errors") * 10 + c("contract_errors") * 10 + c("ci_signals") * 8 + F.least(F.lit(15), c("hot_zones") * 2) + F.least(F.lit(22), c("lifecycle_owners") * 12 + c("lifecycle_risks") * 3)
    raw = raw + c("new_cycles") * 15 + c("regressed_signals") * 10 + c("new_signals") * 5 - F.least(F.lit(15), c("resolved_cycles") * 6 + c("resolved_signals") * 3)
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")
    return parts.select(raw.cast("long").alias("raw"), score.alias("score"), F.when(score >= 80, "critical").when(score >= 55, "high").when(score >= 25, "medium").otherwise("low").alias("level"))


def briefing(recommendations: DataFrame, top: int = 3, per_kind: int = 2) -> DataFrame:
    """The first findings by weight, at most ``per_kind`` of one kind."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("weight").desc(), "id"))
    return recommendations.withColumn("place", place).where(F.col("place") <= per_kind).orderBy(F.col("weight").desc(), "id").limit(top).select("id", "kind", half_up(F.col("weight")).alias("weight"))


def affected_areas(findings: DataFrame) -> DataFrame:
    """Findings ``(what, id)`` by area."""
    return findings.groupBy(area(F.col("id")).alias("area")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_modules"))


# Paths of code that tools write, index files, and which findings a repair group takes.
_GENERATED = r"(?i)(^|/)(generated|__generated__|openapi|swagger|graphql-codegen)(/|$)"
_INDEX = r"(^|/)index\.[cm]?[jt]sx?$"
SAFE_FIRST = ("unreachable-from-entries", "barrel-cycle")
REVIEW_FIRST = ("cycle", "layer-violation", "contract-violation", "hot-zone")


def generated_modules(modules: DataFrame) -> DataFrame:
    """``id`` of modules that are marked as generated or look like it."""
    marked = F.col("is_generated") if "is_generated" in modules.columns else F.lit(False)
    return modules.where(marked | F.col("id").rlike(_GENERATED)).select("id")


def fix_findings(cycles: DataFrame, violations: DataFrame, dead: DataFrame, contracts: DataFrame, hot: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``type, id, weight, targets, stage, by, then``: the eight types of findings that a plan ranks.

    The first 20 cycles, 50 layer violations, 50 contract violations and 50 hot
    zones are taken, as the plan defines, all unreachable modules and
    recommendations; those of which no module (of layer violations: one end)
    is under review are left out. ``stage, by, then`` order equal weights.
    """
    reviewed = lambda names: F.exists(names, is_review)
    rated = lambda error, other: F.when(F.col("severity") == "error", error).otherwise(other)

    def rows(df: DataFrame, type_: str, id_: Column, weight: Column, targets: Column, stage: int, by: Column, then: Column) -> DataFrame:
        return df.select(F.lit(type_).alias("type"), id_.alias("id"), weight.cast("double").alias("weight"), targets.alias("targets"), F.lit(stage).alias("stage"), by.cast("double").alias("by"), then.cast("string").alias("then"))

    ends, none, id_ = F.array("src", "dst"), F.lit(0), F.col("id")
    rings = cycles.orderBy(F.col("length").desc(), "id").limit(20).where(reviewed("modules"))
    direct = lambda one, other: F.when(F.col("severity") == "direct", one).otherwise(other)
    barrels = rings.where(F.exists("modules", lambda m: m.rlike(_INDEX)))
    lines = violations.orderBy("ord").limit(50).where(is_review(F.col("src")) & is_review(F.col("dst")))
    broken = contracts.withColumn("targets", F.array_compact(ends)).orderBy("ord").limit(50).where(reviewed("targets"))
    zones = hot.orderBy(F.col("hotness").desc(), "id").limit(50).where(is_review(id_))
    parts = [
        rows(rings, "cycle", id_, direct(100, 82), F.col("modules"), 0, -F.col("length"), id_),
        rows(barrels, "barrel-cycle", F.concat(id_, F.lit(":barrel")), direct(92, 74), F.col("modules"), 0, -F.col("length"), id_),
        rows(lines, "layer-violation", F.col("edge_id"), rated(88, 66), ends, 1, none, F.col("ord")),
        rows(lines, "move-module", F.concat("edge_id", F.lit(":move")), rated(84, 58), ends, 1, none, F.col("ord")),
        rows(dead, "unreachable-from-entries", F.concat(id_, F.lit(":unreachable")), F.least(F.lit(70.0), 35 + F.col("loc") / 10), F.array(id_), 2, -F.col("loc"), id_),
        rows(broken, "contract-violation", id_, rated(86, 64), F.col("targets"), 3, none, F.col("ord")),
        rows(zones, "hot-zone", id_, F.least(F.lit(80.0), F.col("hotness") * 10), F.array(id_), 4, -F.col("hotness"), id_),
        rows(recommendations.where(reviewed("modules")), "recommendation", id_, F.col("weight"), F.col("modules"), 5, -F.col("weight"), id_),
    ]
    return reduce(DataFrame.unionByName, parts)


def fix_plan(findings: DataFrame, generated: DataFrame, top: int = 100, group: int = 8) -> DataFrame:
    """The ``top`` findings by weight: ``place, type, id, weight, targets, generated, groups``.

    A finding all of whose targets are generated weighs a tenth. ``groups`` names
    the repair groups that a finding is among the first ``group`` of.
    """
    hit = findings.select("type", "id", F.explode("targets").alias("t")).join(generated.select(F.col("id").alias("t"), F.lit(1).alias("g")), "t", "left")
    whole = hit.groupBy("type", "id").agg((F.count("g") == F.count(F.lit(1))).alias("generated"))
    rows = findings.join(whole, ["type", "id"], "left").withColumn("generated", F.coalesce("generated", F.lit(False)))
    rows = rows.withColumn("weight", F.when(F.col("generated"), F.col("weight") * 0.1).otherwise(F.col("weight")))
    order = [F.col("weight").desc(), "stage", "by", "then", "type"]
    best = rows.orderBy(*order).limit(top)
    tests = {
        "safe-first": F.col("type").isin(*SAFE_FIRST), "high-impact": (F.col("weight") >= 80) & ~F.col("generated"), "review-before-change": F.col("type").isin(*REVIEW_FIRST),
    }
    upto = Window.orderBy(*order)  # over the ``top`` rows only
    among = {name: F.sum(F.when(test, 1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for name, test in tests.items()}
    groups = F.array_compact(F.array(*(F.when(tests[name] & (among[name] <= group), F.lit(name)) for name in tests)))
    return best.select(F.row_number().over(upto).alias("place"), "type", "id", "weight", "targets", "generated", groups.alias("groups"))


def hygiene(metrics: DataFrame, risks: DataFrame, top: int = 30) -> DataFrame:
    """Five lists of at most ``top`` modules: ``list, place, id, value, note``.

    ``removable``, ``entry-candidate`` and ``generated-pressure`` come from the
    metrics (``value`` is their risk), ``lifecycle-risk`` and
    ``side-effect-owner`` from the risks ``id, confidence`` (``value`` is their
    number; ``note`` the highest confidence, or whether the place suits them).
    """
    generated = F.col("is_generated") if "is_generated" in metrics.columns else F.lit(False)
    worth = F.col("loc") + F.col("n_exports") * 4 + F.col("fan_in") * 3 + F.col("fan_out") * 2
    items = metrics.where(is_review(F.col("id")) & (F.col("loc") > 0)).withColumns({"value": worth.cast("long"), "generated": generated, "note": F.lit("")})

    def listed(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        order = [*order, F.col("id")]
        best = rows.orderBy(*order).limit(top)  # so the window is over a few rows
        return best.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "id", "value", "note")

    plain = items.where("kind NOT IN ('entry', 'test') AND NOT generated AND fan_in = 0")
    owners = side_effect_owners(metrics, risks)
    parts = [
        listed(plain.where("fan_out = 0 AND n_exports = 0 AND NOT is_infra"), "removable", F.col("value").desc()),
        listed(plain.where("fan_out > 0"), "entry-candidate", F.col("fan_out").desc(), F.col("value").desc()),
        listed(items.where("generated AND (fan_in + fan_out >= 20 OR loc >= 500)"), "generated-pressure", F.col("value").desc()),
        listed(owners.withColumn("note", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("sure").cast("int"))), "lifecycle-risk", F.col("value").desc(), F.col("sure").desc()),
        listed(owners, "side-effect-owner", F.col("note").desc(), F.col("value").desc()),
    ]
    return reduce(DataFrame.unionByName, parts)


def side_effect_owners(modules: DataFrame, risks: DataFrame) -> DataFrame:
    """Modules with lifecycle risks: ``id, value, sure, note`` - how many, how sure, and whether the place suits them (``owned``) or not (``review``)."""
    by_module = risks.groupBy("id").agg(F.count(F.lit(1)).alias("value"), F.max(place(F.col("confidence"), CONFIDENCES)).alias("sure"))
    owned = F.col("kind").isin("component", "composable", "service", "store", "route", "entry", "integration")
    homeless = F.col("id").rlike(r"/shared/(lib|utils?|model|schema|config)(/|\.)") | ~F.coalesce(owned, F.lit(False))
    rows = by_module.join(modules.select("id", "kind"), "id", "left")
    return rows.select("id", "value", "sure", F.when(homeless, "review").otherwise("owned").alias("note"))


def unowned_hot(hot: DataFrame) -> DataFrame:
    """Hot zones that belong to no area: ``id``."""
    return hot.where(is_review(F.col("id")) & ((area(F.col("id")) == "project") | (folder(F.col("id")) == "."))).select("id")


def report_status(debt: DataFrame, cycles: DataFrame, violations: DataFrame, contracts: DataFrame, hot: DataFrame, signals: DataFrame, warnings: DataFrame, misconfigured: bool = False) -> DataFrame:
    """``status`` of a report in one row: ``blocking``, ``review`` or ``clean``."""
    seen = lambda df, name, test=None: df.agg(F.coalesce(F.max(F.lit(True) if test is None else test), F.lit(False)).alias(name))
    error = F.col("severity") == "error"
    row = debt.select(F.col("grade").isin("D", "F").alias("poor"))
    facts = [seen(contracts, "broken", error), seen(violations, "crossed", error), seen(cycles, "direct", F.col("severity") == "direct"), seen(cycles, "rings"), seen(hot, "zones"), seen(signals, "signs"), seen(warnings, "warned")]
    for fact in facts:
        row = row.crossJoin(fact)  # one row each
    blocking = F.lit(misconfigured) | F.expr("broken OR crossed OR direct OR poor")
    return row.select(F.when(blocking, "blocking").when(F.expr("rings OR zones OR signs OR warned"), "review").otherwise("clean").alias("status"))


def ui_matrix(edges: DataFrame, cycles: DataFrame, violations: DataFrame, grouping: str = "area", only_violations: bool = False) -> DataFrame:
    """The matrix as a screen shows it: groups in the order in which edges (``ord``) name them.

    ``from_group, from_place, to_group, to_place, imports, violations, severity,
    cycle_edges``. An edge counts as one of a cycle only between members that
    follow each other in its sorted list.
    """
    by = GROUPINGS[grouping]
    rows = edges.select("ord", "src", "dst", by(F.col("src")).alias("from_group"), by(F.col("dst")).alias("to_group")).where("from_group <> to_group")
    bad = violations.groupBy("src", "dst").agg(F.max(F.when(F.col("severity") == "error", 2).otherwise(1)).alias("bad"))
    rows = rows.join(bad, ["src", "dst"], "left")
    if only_violations:
        rows = rows.where("bad IS NOT NULL")
    nth = F.expr("modules[(k + 1) % size(modules)]")
    follow = cycles.select("modules", F.posexplode("modules").alias("k", "src")).select("src", nth.alias("dst"), F.lit(1).alias("ring")).distinct()
    rows = rows.join(follow, ["src", "dst"], "left")
    cells = rows.groupBy("from_group", "to_group").agg(
        F.count(F.lit(1)).alias("imports"), F.count("bad").alias("violations"), F.coalesce(F.max("bad"), F.lit(0)).alias("worst"), F.count("ring").alias("cycle_edges"), F.min("ord").alias("ord")
    )
    cells = written(cells, "cells")  # edges are joined once, for the cells and for who is named first
    named = cells.select(F.explode(F.array(F.struct("ord", F.lit(0).alias("side"), F.col("from_group").alias("g")), F.struct("ord", F.lit(1).alias("side"), F.col("to_group").alias("g")))).alias("n")).select("n.*")
    first = named.groupBy("g").agg(F.min(F.struct("ord", "side")).alias("at"))
    order = first.select("g", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("place"))  # a row a group
    ends = [order.select(F.col("g").alias(f"{side}_group"), F.col("place").alias(f"{side}_place")) for side in ("from", "to")]
    cells = cells.join(ends[0], "from_group").join(ends[1], "to_group")
    severity = F.element_at(F.array(*map(F.lit, ("normal", "warning", "error"))), F.col("worst") + 1)
    return cells.select("from_group", "from_place", "to_group", "to_place", "imports", "violations", severity.alias("severity"), "cycle_edges")


def history(snapshots: DataFrame) -> DataFrame:
    """Scans in time with the change of the score since the one before."""
    w = Window.partitionBy("project").orderBy("scanned_at")
    return snapshots.select("project", "scanned_at", "score", (F.col("score") - F.lag("score").over(w)).alias("delta"))


def kept_snapshots(snapshots: DataFrame, each: int = 10) -> DataFrame:
    """The newest of each project; one of several with the same time (the last written)."""
    once = snapshots.groupBy("project", "scanned_at").agg(F.max_by("score", "written").alias("score"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.col("scanned_at").desc()))).where(F.col("place") <= each).drop("place")


def fan_summary(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, all edge kinds told apart."""
    kinds = edges.groupBy().agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "type-only").alias("type_only"), F.count_if(F.col("kind") == "dynamic").alias("dynamic"))
    return modules.agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc")).crossJoin(kinds)


