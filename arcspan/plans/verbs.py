"""The verbs of a command line, as functions, and the store of earlier scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, graph, recommend, rules
from ..operators import diff as differ
from ..session import written
from ..sources import files, resolve
from ..sources.aliases import project_aliases
from . import report, store, views
from .config import Config, initial, load
from .scan import Scan, analyse, compared, measured

#: Where bundlers leave their statistics.
STATS = ("bundle-stats.json", "dist/stats.json")


def project(spark: SparkSession, root: str, **options) -> dict:
    """What a folder says about itself: framework, aliases of its compiler, bundler and packages, pages, bundle statistics."""
    notes = written(files.manifests(spark, root), "manifests")
    small = {r.rel_path: r.content for r in notes.where("rel_path NOT LIKE '%/%'").select("rel_path", "content").collect()}  # the root's own few
    found = {"framework": resolve.framework(small["package.json"]) if "package.json" in small else "generic"}
    declared = resolve.tsconfig_aliases(lambda p: _text(notes, p))
    declared += next((resolve.vite_aliases(small[f]) for f in sorted(small) if f.startswith("vite.config.")), [])
    found["aliases"] = project_aliases(notes, options.get("framework") or found["framework"], declared)
    found["html"] = notes.where("rel_path LIKE '%.html'").select("content")
    for name in STATS:
        if (text := _text(notes, name)) and (rows := bundle.stats_rows(text)):
            found["chunks"] = spark.createDataFrame(rows, "chunk_id string, path string, size long").withColumn("path", bundle.normal_path(F.col("path"), root))
            break
    return found | options


def _text(notes: DataFrame, path: str) -> str | None:
    row = notes.where(F.col("rel_path") == path).select("content").first()
    return row.content if row else None


def scan(spark: SparkSession, root: str, config: str | None = None, cache: str | None = None, **options) -> Scan:
    """A scan of a folder, with a configuration's text; through a cache, if it has a place."""
    settings = load(config)[0] if config else Config()
    about = project(spark, root, **options)
    if cache is None:
        return analyse(spark, files.read(spark, root), settings, **about)
    return store.rescanned(spark, files.read(spark, root), cache, settings, **about)[0]


overview = analyze = scan


def init(scan: Scan) -> str:
    """A first configuration: the layers there are."""
    found = scan.modules.select(rules.layer(F.col("id")).alias("layer")).distinct().where("layer <> 'unknown'").collect()  # seven at most
    return initial(sorted(r.layer for r in found), [])


def baseline(scan: Scan, folder: str, project: str, at: str) -> None:
    """Keeps the graph of a scan; the same time replaces itself, and everything else follows from the graph."""
    path = f"{folder}/project={project}/at={at}"
    store.keep(scan.base, path)
    store.note(scan.modules.sparkSession, f"{path}/about", framework=scan.framework)


def stored(spark: SparkSession, folder: str, project: str, at: str, config: Config | None = None) -> Scan:
    path = f"{folder}/project={project}/at={at}"
    return measured(store.kept(spark, path), config or Config(), store.noted(spark, f"{path}/about").get("framework", "generic"))


def diff(before: Scan, after: Scan) -> DataFrame:
    return differ.summary(compared(before, after))


def check(scan: Scan, gates: list[str], before: Scan | None = None):
    return report.check(scan, gates, before)


ci = check


def suggest(scan: Scan) -> DataFrame:
    return rules.suggestions(scan.modules, scan.edges, scan.members)


def matrix(scan: Scan, grouping: str = "area", only: str | None = None, top: int | None = 50) -> DataFrame:
    return views.matrix(scan.edges, scan.members, scan.violations, grouping, only, top)


def targets(scan: Scan, text: str) -> DataFrame:
    """Modules that a target means: an id, else an area, else a layer, else a folder."""
    path = F.col("id")
    for test in (path == text, views.area(path) == text, rules.layer(path) == text, path.startswith(text.rstrip("/") + "/")):
        found = scan.modules.where(test).select("id")
        if found.limit(1).count():
            return found
    return scan.modules.limit(0).select("id")


def impact(scan: Scan, text: str, depth: int = 3, direction: str = "both", group: str | None = None) -> DataFrame:
    """What a change of the target reaches: ``id, distance, risk``, or per group the number and the nearest."""
    rows = graph.impact(scan.edges, targets(scan, text), depth, direction).join(scan.risks.select("id", "risk"), "id")
    if group is None:
        return rows.orderBy("distance", F.col("risk").desc(), "id")
    return rows.groupBy(views.GROUPINGS[group](F.col("id")).alias("name")).agg(F.count(F.lit(1)).alias("modules"), F.min("distance").alias("nearest"), F.sum("risk").alias("risk")).orderBy(F.col("risk").desc(), "name")


def explain(scan: Scan, what: str) -> dict:
    return report.explain(scan, what)


def review(scan: Scan, before: Scan | None = None) -> DataFrame:
    """Score and level of what a review has to look at; with an earlier scan, what is new, worse or gone counts too."""
    blocking = scan.signals.withColumn("status", F.lit("active")).where(recommend.can_fail_ci("high"))
    risks = scan.base.lifecycles
    owners = views.side_effect_owners(scan.modules, risks).where("note = 'review'")
    changed = {}
    if before is not None:
        for r in compared(before, scan).groupBy("what", "change").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a kind and change
            changed[f"{r.change}_{r.what}"] = r.n
    parts = views.review_parts(scan.debt.select(F.col("score").alias("debt")), scan.cycles, scan.violations, scan.contracts, blocking, scan.hot, owners, risks, changed)
    return views.review_risk(parts)


def save(scan: Scan, folder: str, form: str = "json") -> None:
    """All tables of a scan as files, each written by the executors that have it; a report of any size."""
    for name, table in scan.tables().items():
        table.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def unowned(scan: Scan) -> DataFrame:
    return views.unowned_hot(scan.hot)


def ownership(scan: Scan) -> DataFrame:
    return views.ownership(scan.metrics, views.finding_modules(scan.hot, scan.members, scan.violations, scan.contracts))


def semantic(scan: Scan) -> DataFrame:
    return views.semantic_surface(scan.metrics)


def hygiene(scan: Scan) -> DataFrame:
    return views.hygiene(scan.metrics, scan.base.lifecycles)


def fix_plan(scan: Scan) -> DataFrame:
    """What to repair first: findings of all types by weight, in repair groups."""
    generated = views.generated_modules(scan.modules)
    dead = views.dead_code(scan.metrics, generated)
    found = views.fix_findings(scan.cycles, scan.violations, dead, scan.contracts, scan.hot, scan.recommendations)
    return views.fix_plan(found, generated)


def trend(before: Scan, after: Scan) -> DataFrame:
    """Direction between two scans."""
    changes = compared(before, after)
    n = lambda what, change: F.count_if((F.col("what") == what) & (F.col("change") == change))
    row = changes.agg(n("cycles", "new").alias("new_cycles"), n("cycles", "resolved").alias("resolved_cycles"), n("signals", "new").alias("new_signals"), n("signals", "regressed").alias("regressed_signals"), n("signals", "resolved").alias("resolved_signals"))
    score = after.debt.select(F.col("score").alias("b")).crossJoin(before.debt.select(F.col("score").alias("a"))).select((F.col("b") - F.col("a")).alias("score_delta"))
    return differ.trend(row.crossJoin(score))


def signals_since(before: Scan, after: Scan) -> DataFrame:
    """Signals of a scan with their status against an earlier one; resolved ones keep what they were."""
    status = recommend.lifecycle(before.signals, after.signals)
    both = after.signals.unionByName(before.signals.join(after.signals.select("stable_key"), "stable_key", "left_anti").select(*after.signals.columns))
    return both.join(status, "stable_key")


def tables(scan: Scan) -> list[str]:
    return list(scan.tables())
