"""A whole scan: from source texts to the tables of a report."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.values import cycle_id
from ..operators import bundle as bundles
from ..operators import cycles, diff, findings, graph, history, lifecycle, metrics, recommend, rules
from ..session import grown, ship, written
from ..sources import facts, files, parse, resolve
from . import views
from .config import Config


@dataclass
class Base:
    """What a scan takes from source texts; all else follows from these tables."""

    modules: DataFrame
    edges: DataFrame
    warnings: DataFrame
    quality: DataFrame
    facts: DataFrame
    lifecycles: DataFrame
    probed: DataFrame  # imports inside cycles: src, dst, specifier and the names that are types only, '' for none


@dataclass
class Scan:
    modules: DataFrame
    edges: DataFrame
    members: DataFrame
    cycles: DataFrame
    metrics: DataFrame
    violations: DataFrame
    contracts: DataFrame
    leaks: DataFrame
    hot: DataFrame
    debt: DataFrame
    breaks: DataFrame
    recommendations: DataFrame
    signals: DataFrame
    risks: DataFrame
    warnings: DataFrame
    budgets: DataFrame
    bundle: DataFrame | None
    base: Base
    framework: str = "generic"

    def tables(self) -> dict[str, DataFrame]:
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "base"}
        more = {f.name: getattr(self.base, f.name) for f in fields(self.base)}
        return {k: v for k, v in (more | own).items() if isinstance(v, DataFrame)}

    def register(self, prefix: str = "") -> None:
        """Every table as a temporary view, for SQL."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(f"{prefix}{name}")


# --- from texts to a graph ------------------------------------------------------------


def discovered(sources: DataFrame, config: Config) -> DataFrame:
    """The files that are source; generated ones too, unless the configuration leaves them out."""
    generated = config.generated if config.generated_mode == "exclude" else ()
    return files.discover(sources, exclude=[*config.exclude, *generated])


def modules_of(parsed: DataFrame, config: Config, framework: str) -> DataFrame:
    path = F.col("rel_path")
    markers = lambda name: F.exists("imports", lambda i: i["specifier"] == name)
    marked = config.generated if config.generated_mode == "classify" else ()
    generated = path.rlike("|".join(map(glob_regex, marked))) if marked else F.lit(False)
    return parsed.select(
        path.alias("id"), files.module_kind(path, F.col("exports"), F.col("defines_store")).alias("kind"), "language", "loc", "exports",
        F.size("exports").cast("long").alias("n_exports"), files.is_infra(path).alias("is_infra"),
        files.runtime(path, F.col("directives"), markers("server-only"), markers("client-only"), framework).alias("runtime"),
        F.array_contains("directives", "use server").alias("is_server_actions"), generated.alias("is_generated"), F.xxhash64(path).alias("ord"),
    )


def imports_of(parsed: DataFrame, config: Config) -> DataFrame:
    """``src, n, kind, specifier, approximate, confidence, pattern`` of all imports, those by configured loaders too."""
    path = F.col("rel_path").alias("src")
    columns = ("src", "n", "kind", "specifier", "approximate", "confidence", "pattern")
    rows = parsed.select(path, F.posexplode("imports").alias("n", "i")).select("src", "n", "i.*").select(*columns)
    if not config.loaders:
        return rows
    table = [(x["name"], int(x.get("argIndex", 0)), x["resolveAs"]) for x in config.loaders]
    loaders = parsed.sparkSession.createDataFrame(table, "callee string, arg int, template string")
    calls = parsed.select(path, F.posexplode("literal_calls").alias("n", "c")).select("src", (F.col("n") + 800_000).alias("n"), "c.*").join(loaders, ["callee", "arg"])
    found = calls.withColumns({"kind": F.lit("dynamic"), "specifier": F.replace("template", F.lit("{0}"), "value"), "approximate": F.lit(False), "confidence": F.lit("high"), "pattern": F.lit(None).cast("string")})
    return rows.unionByName(found.select(*columns))


def links_of(wanted: DataFrame, known: DataFrame, aliases: list) -> DataFrame:
    """Imports by name with ``bases`` and ``dst``; those of assets and of packages are left out."""
    return resolve.targets(wanted.where("pattern IS NULL"), known, aliases)


def edges_of(parsed: DataFrame, wanted: DataFrame, links: DataFrame, framework: str) -> tuple[DataFrame, DataFrame]:
    """Edges, and warnings of what should have been one."""
    known = parsed.select("rel_path")
    place = F.concat_ws("|", "src", F.lpad(F.col("n").cast("string"), 6, "0"), "dst")
    edge = lambda df: df.withColumn("ord", place).withColumn("resolved", F.lit(True)).select("ord", "src", "dst", "kind", "specifier", "resolved", "confidence")
    guessed = lambda df, n: edge(df.withColumns({"n": F.lit(n), "kind": F.lit("dynamic"), "specifier": F.col("dst"), "confidence": F.lit("low")}))
    edges = edge(links.where("dst IS NOT NULL"))
    edges = edges.union(guessed(resolve.expanded_globs(wanted.where("pattern = 'glob'").select("src", F.col("specifier").alias("pattern")), known), 900_000))
    prefixes = wanted.where("kind = 'dynamic' AND pattern = 'prefix' AND specifier LIKE '.%/%'").select("src", F.col("specifier").alias("prefix"))
    edges = edges.union(guessed(resolve.expanded_prefixes(prefixes, known), 900_001))
    names = F.concat("tags", "calls") if framework == "nuxt" else F.col("tags")
    uses = parsed.select(F.col("rel_path").alias("src"), F.explode(names).alias("name"))
    edges = edges.union(guessed(resolve.registered(uses, known, edges), 900_002))
    lost = links.where("dst IS NULL").select(F.lit("resolve-failed").alias("code"), F.col("src").alias("file"), F.col("specifier").alias("detail"))
    return edges, lost


def based(parsed: DataFrame, found: DataFrame, wanted: DataFrame, links: DataFrame, config: Config, framework: str, probed: DataFrame | None = None) -> Base:
    """The tables of a scan from parsed files; ``found`` has the texts, of which only files of cycles are read.

    ``probed`` holds what earlier probes said of files that haven't changed.
    """
    modules = grown(modules_of(parsed, config, framework), "modules")
    edges, lost = edges_of(parsed, wanted, links, framework)
    edges = grown(edges, "edges")
    summaries = facts.summarised(parsed, framework)
    marked = parsed.select(F.col("rel_path").alias("id"), "marks").join(modules.select("id", "runtime"), "id")
    members = graph.scc(edges)
    texts = found.select(F.col("rel_path").alias("id"), "content").hint("merge")
    return Base(
        modules, edges, lost.union(parse.unparsed(found).withColumn("detail", F.lit(""))), facts.quality(summaries), facts.facts(summaries),
        lifecycle.risks(marked, framework), grown(findings.probed_types(texts, edges, members, probed), "probed"),
    )


def read(sources: DataFrame, config: Config, aliases: list, framework: str) -> Base:
    found = discovered(sources, config)
    parsed = grown(parse.parse(found, callees=tuple(x["name"] for x in config.loaders)), "parsed")
    wanted = imports_of(parsed, config)
    return based(parsed, found, wanted, written(links_of(wanted, parsed.select("rel_path"), aliases), "links"), config, framework)


# --- from a graph to a report ---------------------------------------------------------


def analyse(
    spark: SparkSession, sources: DataFrame, config: Config | None = None, aliases: list = (), framework: str = "generic",
    html: DataFrame | None = None, chunks: DataFrame | None = None,
) -> Scan:
    """Everything a report needs; each table is lazy but for what several stages read.

    ``html`` (``content``) names entry points, ``chunks`` (``chunk_id, path,
    size``) is what a bundler says.
    """
    ship(spark)
    config = config or Config()
    return measured(read(sources, config, list(aliases), framework), config, framework, html, chunks)


def contracts_of(modules: DataFrame, edges: DataFrame, members: DataFrame, config: Config, leaks: DataFrame, fans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Violations of all contracts, runtime leaks first, and those of budgets by themselves."""
    columns = ("id", "rule", "severity", "src", "dst", "specifier", "ord")
    leaked = leaks.select(
        F.concat(F.lit("rsc-leak:"), "src", F.lit("\x01"), "dst").alias("id"), F.lit("rsc-leak").alias("rule"), F.lit("error").alias("severity"), "src", "dst", F.lit("").alias("specifier"),
        F.concat_ws("|", F.lit("0"), F.when(F.col("direct"), "0").otherwise("1"), "src", "dst").alias("ord"),
    )
    parts = [leaked]
    if config.boundaries:
        parts.append(rules.boundary_violations(edges, config.boundaries).withColumn("ord", F.concat(F.lit("1|"), "ord")))
    none = "id string, rule string, severity string, module string, metric string, value long, limit long"
    budgets = rules.budget_violations(fans, members, config.budgets) if config.budgets else modules.sparkSession.createDataFrame([], none)
    parts.append(budgets.select("id", "rule", "severity", F.col("module").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("metric").alias("specifier"), F.concat_ws("|", F.lit("2"), "id").alias("ord")))
    return reduce(DataFrame.union, [p.select(*columns) for p in parts]), budgets


def bundle_findings(modules: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``kind, key, severity`` of everything heavy in the bundles, and the recommendations that follow."""
    rows = bundles.attached(chunks, modules)
    one = lambda c: F.array_compact(F.array(c))
    parts = [
        ("duplicate", bundles.duplicates(rows), one(F.col("id")), F.col("id")), ("heavy-chunk", bundles.heavy(rows), F.array().cast("array<string>"), F.col("chunk_id")),
        ("solo-hot", bundles.solo_hot(rows), one(F.col("id")), F.col("chunk_id")), ("barrel-leak", bundles.barrel_leaks(modules, edges, rows), one(F.col("src")), F.col("src")),
    ]
    table = reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), key.alias("key"), "severity", mods.alias("modules")) for kind, df, mods, key in parts])
    return table, [recommend.from_bundle(kind, df, mods, key) for kind, df, mods, key in parts]


def measured(base: Base, config: Config, framework: str = "generic", html: DataFrame | None = None, chunks: DataFrame | None = None) -> Scan:
    """A scan of a known graph; the same for a full, a stored and an incremental one.

    Imports whose names are types only vanish when the code is compiled, so
    they are taken out of the cycles: components that lose such an edge are
    searched again. Everything else counts them.
    """
    modules, edges = base.modules, base.edges
    erased = base.probed.where("names <> ''")
    members = written(graph.scc_after(edges, graph.scc(edges), erased), "members")
    firm = written(graph.without(edges, erased), "firm")
    rings = graph.cycles(members)
    entries = resolve.entries(modules.select(F.col("id").alias("rel_path")), framework, config.entries, html).select(F.col("rel_path").alias("id"))
    m = written(metrics.module_metrics(modules, edges, members, graph.depths(modules, edges, members, entries)), "metrics")
    violations = written(rules.layer_violations(modules, edges, config.layers), "violations")
    leaks = graph.runtime_leaks(modules, edges)
    contracts, budgets = contracts_of(modules, edges, members, config, leaks, m)
    contracts = written(contracts, "contracts")
    hot = metrics.hot_zones(m, config.hot_zones)
    breaks = written(cycles.explained(firm, members), "breaks")
    shapes = breaks.groupBy("comp").agg(F.min("pattern").alias("pattern"), F.count(F.lit(1)).alias("feedback"))
    parts = [
        recommend.god_modules(m), recommend.unused_utilities(m, entries), recommend.from_cycles(rings, shapes), recommend.from_type_only(erased), recommend.misplaced(modules, edges),
        recommend.from_isolated(graph.isolated(modules, edges, entries)), recommend.top_violators(violations), recommend.from_contracts(contracts),
    ]
    bundle = None
    if chunks is not None:
        bundle, more = bundle_findings(modules, edges, chunks)
        bundle = written(bundle, "bundle")
        parts += more
    recs = written(recommend.ranked(parts, hot), "recommendations")
    signals = recommend.all_signals(recs, base.quality, base.warnings, base.lifecycles)
    signals = recommend.suppressed_by(signals, config.suppressions, config.today)
    return Scan(
        modules, edges, members, rings.withColumn("id", cycle_id(F.col("modules"))), m, violations, contracts, leaks, hot, metrics.arch_debt(m, rings, violations, hot), breaks, recs, signals,
        views.module_risk(m, members, violations, contracts, hot), base.warnings, budgets, bundle, base, framework,
    )


def compared(before: Scan, after: Scan) -> DataFrame:
    """``what, key, change`` over modules, cycles, violations and signals."""
    names = lambda s: s.cycles.select(F.array_join("modules", ",").alias("members"))
    out = diff.modules(before.modules, after.modules).select(F.lit("modules").alias("what"), F.col("id").alias("key"), "change")
    out = out.union(diff.keyed(names(before), names(after), "members", "cycles"))
    out = out.union(diff.keyed(before.violations, after.violations, "edge_id", "layer_violations"))
    contract = lambda s: s.contracts.select(F.concat_ws("|", "rule", "src", F.coalesce("dst", "specifier")).alias("key"))
    out = out.union(diff.keyed(contract(before), contract(after), "key", "contract_violations"))
    return out.union(recommend.lifecycle(before.signals, after.signals).select(F.lit("signals"), "stable_key", "status"))


def with_history(scan: Scan, commits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return history.churn(scan.modules, commits, changes), history.temporal_coupling(scan.modules, scan.edges, changes)
