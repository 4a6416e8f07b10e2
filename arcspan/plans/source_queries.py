"""Registered queries over source texts that Spark makes of the tables, and their SQL.

Rings: the line items of four orders after another are modules ``r<ring>/m<k>``,
each importing the next one, the last the first, some of them one more. Of some
imports only a type is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import testdata as data
from ..operators import cycles, findings, graph, lifecycle
from ..session import shared_dir, written
from ..sources import facts, files, parse
from . import store
from .config import Config
from .queries import query
from .scan import imports_of, links_of

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def ring_edges(spark: SparkSession, d: str, chords: bool = True) -> DataFrame:
    """``src, dst, specifier, kind, typed``: rings of the line items of four orders, with chords."""
    ring = F.floor(F.col("l_orderkey") / 4)
    rows = data.table(spark, d, "lineitem").withColumn("ring", ring)
    each, all_ = Window.partitionBy("ring").orderBy(*LINES.split(", ")), Window.partitionBy("ring")
    rows = rows.select("ring", (F.row_number().over(each) - 1).alias("k"), F.count(F.lit(1)).over(all_).alias("n"), "l_quantity", "l_suppkey")
    chord = F.when(F.lit(chords) & (F.col("l_quantity") >= 40) & ((F.col("l_suppkey") % F.col("n")) > 1), (F.col("k") + F.col("l_suppkey")) % F.col("n"))
    ends = F.array_compact(F.array(F.struct(((F.col("k") + 1) % F.col("n")).alias("to"), (F.col("l_quantity") < 4).alias("typed")), F.when(chord.isNotNull(), F.struct(chord.alias("to"), (F.col("l_quantity") >= 48).alias("typed")))))
    named = lambda k: F.concat(F.lit("r"), F.col("ring").cast("string"), F.lit("/m"), F.col(k).cast("string"), F.lit(".ts"))
    rows = rows.select("ring", "k", F.explode(ends).alias("e")).select("ring", "k", F.col("e.to").alias("to"), "e.typed")
    return rows.select(named("k").alias("src"), named("to").alias("dst"), F.concat(F.lit("./m"), F.col("to").cast("string")).alias("specifier"), F.lit("static").alias("kind"), "typed")


def ring_texts(edges: DataFrame) -> DataFrame:
    """``rel_path, content`` of the modules of rings: types stand in annotations, values are called."""
    name = F.concat(F.lit("T"), F.expr("substring(specifier, 4)"))
    imported = F.concat(F.lit("import { "), name, F.lit(" } from '"), F.col("specifier"), F.lit("'"))
    used = F.when(F.col("typed"), F.concat(F.lit("let a: "), name, F.lit(" | null = null"))).otherwise(F.concat(F.lit("const b = { x: "), name, F.lit(" }")))
    lines = edges.groupBy(F.col("src").alias("rel_path")).agg(F.array_sort(F.collect_list(imported)).alias("i"), F.array_sort(F.collect_list(used)).alias("u"))
    return lines.select("rel_path", F.array_join(F.concat("i", "u"), "\n").alias("content"))


@query
def ring_erasure(spark, d):
    """Components of the rings once the imports of types are gone, from those before."""
    edges = written(ring_edges(spark, d), "rings")
    return graph.scc_after(edges, written(graph.scc(edges), "members"), edges.where("typed"))


@query
def type_only_imports(spark, d):
    """Imports of types inside cycles, read from the texts."""
    edges = written(ring_edges(spark, d), "rings")
    texts = ring_texts(edges).withColumnRenamed("rel_path", "id")
    return findings.type_only_candidates(texts, edges, graph.scc(edges)).select("src", "dst", "specifier", "names")


@query
def ring_breaks(spark, d):
    """The edge to cut in each ring without chords, and what the ring looks like."""
    edges = written(ring_edges(spark, d, chords=False), "rings")
    return cycles.explained(edges, graph.scc(edges)).select("src", "dst", "broken", "partial", "total_cycles", "pattern", "breakpoint")


def _routes(spark, d) -> DataFrame:
    """Files of a framework, made of the parts."""
    p = data.table(spark, d, "part")
    shapes = ("app/s{0}/page.tsx", "app/s{0}/layout.tsx", "app/api/s{0}/route.ts", "pages/api/s{0}.ts", "pages/s{0}.tsx", "middleware.ts", "server/s{0}.ts", "lib/s{0}.ts")
    at = (F.col("p_partkey") % len(shapes) + 1).cast("int")
    path = F.concat(F.lit("w"), F.col("p_partkey").cast("string"), F.lit("/"), F.replace(F.element_at(F.array(*map(F.lit, shapes)), at), F.lit("{0}"), F.col("p_size").cast("string")))
    head = F.when(F.col("p_size") % 3 == 0, "'use client'\n").when(F.col("p_size") % 3 == 1, "'use server'\n").otherwise("")
    more = F.when(F.col("p_size") % 5 == 0, "const all = import.meta.glob('./x/*.ts')\n").when(F.col("p_size") % 5 == 1, "import(`./v/${x}.ts`)\n").when(F.col("p_size") % 5 == 2, "import './a.css'\nimport l from './l.svg'\n")
    out = F.when(F.col("p_size") % 2 == 0, "export default 1\nexport const q = 2\n").otherwise("defineStore('x')\n")
    return p.select(path.alias("rel_path"), F.concat(head, F.coalesce(more, F.lit("")), out).alias("content"))


@query
def source_facts(spark, d):
    summaries = facts.summarised(parse.parse(_routes(spark, d)), "next")
    return facts.facts(summaries).groupBy("fact", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query
def parser_doubts(spark, d):
    return facts.quality(facts.summarised(parse.parse(_routes(spark, d)), "next"))


LOADERS = ({"name": "loadView", "resolveAs": "../views/{0}"}, {"name": "lazy", "argIndex": 1, "resolveAs": "/pages/{0}.vue"})


@query
def loader_edges(spark, d):
    """Edges by configured loaders: the first argument of one, the second of another; others and names are none."""
    p = data.table(spark, d, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    call = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("loadView('v"), size, F.lit("', 'x')"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("lazy({ a: [1, 2] }, 'p"), size, F.lit("')\nobj.loadView('v1')"))).otherwise("loadView(name)\nother('v1')")
    texts = p.select(F.concat(F.lit("src/"), k, F.lit(".ts")).alias("rel_path"), call.alias("content"))
    sizes = p.select("p_size").distinct()
    targets = sizes.select(F.concat(F.lit("views/v"), F.col("p_size").cast("string"), F.lit(".ts")).alias("rel_path"), F.lit("").alias("content"))
    targets = targets.union(sizes.select(F.concat(F.lit("pages/p"), F.col("p_size").cast("string"), F.lit(".vue")), F.lit("")))
    config = Config(loaders=LOADERS)
    parsed = written(parse.parse(texts.union(targets), callees=tuple(x["name"] for x in LOADERS)), "parsed")
    return links_of(imports_of(parsed, config), parsed.select("rel_path"), []).where("dst IS NOT NULL").select("src", "dst", "kind", "specifier")


@query
def lifecycle_scopes(spark, d):
    """What mount hooks acquire and don't give back, in components made of the events."""
    e = data.table(spark, d, "events").select("event_id", "user_id").repartition("event_id")  # texts are more work than their rows have bytes
    k = (F.col("event_id") % 6).cast("int") + 1
    acquire = F.element_at(F.array(*map(F.lit, ("window.addEventListener('x', f)", "t = setInterval(f, 9)", "o = new ResizeObserver(f)", "u = URL.createObjectURL(b)", "s = store.subscribe(f)", "await load()"))), k)
    release = F.element_at(F.array(*map(F.lit, ("window.removeEventListener('x', f)", "clearInterval(t)", "o.disconnect()", "URL.revokeObjectURL(u)", "s.unsubscribe()", "c.abort()"))), k)
    way = F.col("user_id") % 4
    text = F.when(way == 0, F.concat(F.lit("onMounted(async () => {\n  "), acquire, F.lit("\n})\nonUnmounted(() => { "), release, F.lit(" })")))
    text = text.when(way == 1, F.concat(F.lit("onMounted(async () => {\n  "), acquire, F.lit("\n})\nfunction later() { "), release, F.lit(" }")))
    text = text.when(way == 2, acquire).otherwise(F.concat(F.lit("\n// onMounted(() => {\nonMounted(async function () { "), acquire, F.lit(" })")))
    parsed = parse.marked(e.select(F.concat(F.lit("src/e"), F.col("event_id").cast("string"), F.lit(".ts")).alias("rel_path"), text.alias("content")))
    rows = parsed.select(F.col("rel_path").alias("id"), F.lit("client").alias("runtime"), "marks")
    return lifecycle.risks(rows, "vue").select("id", "risk", "kind", F.col("line").cast("long").alias("line"), "confidence")


@query
def ignored_files(spark, d):
    """Modules that nested ignore files leave out, with patterns that take back and folders that can't be taken back."""
    lines = [("", 0, "# none"), ("", 1, "small/"), ("", 2, "!src/app/small/"), ("", 3, "*7.ts"), ("", 4, "/src/core/large"), ("", 5, "!src/core/large/11.ts"), ("src/app", 0, "!*7.ts"), ("src/shared", 0, "**/1*.ts"), ("src/shared", 1, "!promo/*")]
    rules = spark.createDataFrame(lines, "folder string, n int, pattern string")
    return files.ignored_paths(data.modules(spark, d).select(F.col("id").alias("rel_path")), rules)


def module_texts(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Texts of the modules with their imports."""
    up = F.concat(F.when(F.col("src").endswith("/index.ts"), "../").otherwise(""), F.lit("../../../"), F.regexp_replace("dst", r"\.ts$", ""))
    line = F.when(F.col("kind") == "type-only", F.concat(F.lit("import type { T } from '"), up, F.lit("'"))).when(F.col("kind") == "dynamic", F.concat(F.lit("import('"), up, F.lit("')")))
    line = line.otherwise(F.concat(F.lit("import { a } from '"), up, F.lit("'\na()")))
    lines = edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))["line"], "\n").alias("content"))
    return modules.select("id", "ord").join(lines, "id", "left").select(F.col("id").alias("rel_path"), F.coalesce("content", F.lit("")).alias("content"), "ord")


@query
def cached_rescan(spark, d):
    """Edges of a rescan through the cache, after some files lost their imports and some are gone."""
    place = f"{shared_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    before = written(module_texts(data.modules(spark, d), data.edges(spark, d)), "sources")
    after = before.where("ord % 10 <> 7").withColumn("content", F.when(F.col("ord") % 10 == 3, "").otherwise(F.col("content")))
    store.refreshed(spark, before.drop("ord"), place)
    base, outcome = store.refreshed(spark, after.drop("ord"), place)
    edges = base.edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    lost = base.warnings.groupBy(F.col("file").alias("src"), F.lit("").alias("dst"), F.col("code").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return edges.union(lost).withColumn("outcome", F.lit(outcome))


_RING = f"""
WITH RECURSIVE line AS (SELECT l_orderkey // 4 AS ring, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY {LINES}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey // 4) AS n, l_quantity AS q, l_suppkey AS s FROM lineitem),
pair AS (SELECT ring, k, (k + 1) % n AS t, q < 4 AS typed FROM line UNION ALL SELECT ring, k, (k + s) % n, q >= 48 FROM line WHERE q >= 40 AND s % n > 1),
named AS (SELECT 'r' || ring || '/m' || k || '.ts' AS src, 'r' || ring || '/m' || t || '.ts' AS dst, './m' || t AS specifier, 'T' || t AS names, typed FROM pair)"""
_ROUTE = """
WITH f AS (SELECT p_partkey % 8 AS r, p_size AS s, p_partkey AS k, ['app/s{0}/page.tsx', 'app/s{0}/layout.tsx', 'app/api/s{0}/route.ts', 'pages/api/s{0}.ts', 'pages/s{0}.tsx', 'middleware.ts', 'server/s{0}.ts', 'lib/s{0}.ts'][p_partkey % 8 + 1] AS shape FROM part)"""
_KIND = "['event-listener-cleanup', 'timer-cleanup', 'observer-cleanup', 'object-url-cleanup', 'subscription-cleanup', 'async-effect-cleanup'][event_id % 6 + 1]"

ORACLE = {
    "ring_erasure": _RING + """, e AS (SELECT DISTINCT src, dst FROM named WHERE (src, dst) NOT IN (SELECT (src, dst) FROM named WHERE typed)),
way AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM way w JOIN e ON w.dst = e.src)
SELECT a.src AS id, least(min(a.dst), a.src) AS comp FROM way a JOIN way b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""",
    "type_only_imports": _RING + " SELECT src, dst, specifier, names FROM named WHERE src <> dst GROUP BY ALL HAVING bool_and(typed)",
    "ring_breaks": _RING + """ SELECT 'r' || ring || '/m' || (n - 1) || '.ts' AS src, 'r' || ring || '/m0.ts' AS dst, CAST(1 AS BIGINT) AS broken, false AS partial, CAST(CASE WHEN n <= 20 THEN 1 ELSE -1 END AS BIGINT) AS total_cycles,
  CASE WHEN n = 2 THEN 'mutual-pair' WHEN n > 8 THEN 'long-chain' ELSE 'mixed' END AS pattern, true AS breakpoint FROM (SELECT DISTINCT ring, n FROM line)""",
    "source_facts": _ROUTE + """
SELECT 'runtime' AS fact, CASE s % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'server' ELSE 'shared' END AS kind, CASE WHEN s % 3 = 2 AND r NOT IN (2, 6) THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'route', ['page', 'layout', 'api', 'api', 'page', 'middleware'][r + 1], 'medium', count(*) FROM f WHERE r < 6 GROUP BY ALL
UNION ALL SELECT 'export', v.kind, 'medium', count(*) FROM f, (VALUES ('default'), ('named')) v(kind) WHERE s % 2 = 0 GROUP BY ALL
UNION ALL SELECT 'state', 'pinia-store', 'high', count(*) FROM f WHERE s % 2 = 1 GROUP BY ALL
UNION ALL SELECT 'asset', v.kind, 'high', count(*) FROM f, (VALUES ('style'), ('image')) v(kind) WHERE s % 5 = 2 GROUP BY ALL""",
    "parser_doubts": _ROUTE + """
SELECT 'w' || k || '/' || replace(shape, '{0}', CAST(s AS VARCHAR)) AS id, CAST(s % 5 < 2 AS BIGINT) AS n_approximate, CAST(s % 5 = 0 AS BIGINT) AS n_low, CAST(s % 5 < 2 AS BIGINT) + CAST(s % 2 = 0 AS BIGINT) AS n_limitations FROM f WHERE s % 5 < 2 OR s % 2 = 0""",
    "loader_edges": """
SELECT 'src/' || p_partkey || '.ts' AS src, 'views/v' || p_size || '.ts' AS dst, 'dynamic' AS kind, '../views/v' || p_size AS specifier FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'src/' || p_partkey || '.ts', 'pages/p' || p_size || '.vue', 'dynamic', '/pages/p' || p_size || '.vue' FROM part WHERE p_partkey % 3 = 1""",
    "lifecycle_scopes": f"""
SELECT 'src/e' || event_id || '.ts' AS id, CASE WHEN event_id % 6 = 5 THEN 'async-lifecycle-risk' ELSE 'memory-risk' END AS risk, {_KIND} AS kind, CASE WHEN user_id % 4 = 3 THEN 3 WHEN event_id % 6 = 5 THEN 1 ELSE 2 END AS line, 'high' AS confidence
FROM events WHERE user_id % 4 IN (1, 3)""",
    "ignored_files": f"""WITH m AS ({data.SQL['module']})
SELECT id AS rel_path FROM m WHERE (id LIKE 'src/%/small/%' AND id NOT LIKE 'src/app/small/%') OR (id LIKE '%7.ts' AND id NOT LIKE 'src/app/%' AND NOT regexp_matches(id, '^src/shared/promo/[^/]*$')) OR id LIKE 'src/core/large/%' OR (regexp_matches(id, '^src/shared/(.*/)?1[^/]*\\.ts$') AND id NOT LIKE 'src/shared/promo/%')""",
    "cached_rescan": f"""WITH m AS ({data.SQL['module']}), edge AS ({data.SQL['edge']}), e AS (SELECT edge.*, a.ord AS a, b.ord AS b FROM edge JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.ord % 10 NOT IN (3, 7))
SELECT src, dst, kind, count(*) AS n, 'incremental' AS outcome FROM e WHERE b % 10 <> 7 GROUP BY ALL UNION ALL SELECT src, '', 'resolve-failed', count(*), 'incremental' FROM e WHERE b % 10 = 7 GROUP BY ALL""",
}
