"""Tables that grow with the project are never broadcast, however small their files are."""

import pytest
from pyspark.sql import functions as F

from arcspan import session
from arcspan.adapters import testdata as data
from arcspan.operators import graph, lifecycle
from arcspan.operators.components import components
from arcspan.plans import scan, store
from arcspan.sources import files, parse, resolve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_globs_are_broadcast_and_files_are_not(spark, sf):
    known = data.modules(spark, sf).select(F.col("id").alias("rel_path"))
    for files in (known, known.hint("merge"), spark.createDataFrame([("a/b.ts",), ("a/c.ts",)], "rel_path string")):
        globs = [("a/main.ts", "./*.ts"), ("a/main.ts", "!./c.ts")]
        text = plan(resolve.expanded_globs(globs, files).select("src", "dst"))
        assert "BroadcastHashJoin" not in text or "BuildLeft" not in text, text
    assert [tuple(r) for r in resolve.expanded_globs(globs, files).collect()] == [("a/main.ts", "a/b.ts")]


def test_modules_and_parts_are_not_broadcast(spark, sf):
    assert "Broadcast" not in plan(data.edges(spark, sf))
    modules, edges = data.modules(spark, sf), data.edges(spark, sf)
    assert "Broadcast" not in plan(edges.join(modules.select(F.col("id").alias("src"), "kind"), "src"))


def test_edges_skip_items_without_a_part_and_those_before_the_first_large_quantity(spark, tmp_path):
    part = [(k, "SMALL", 1) for k in (1, 2, 3, 4)] + [(4, "LARGE", 1)]
    spark.createDataFrame(part, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = [
        (1, 1, 1, 10.0), (1, 2, 2, 49.0), (1, 3, 99, 50.0), (1, 4, 3, 1.0), (1, 5, 1, 2.0),  # 2 leads to 3, over an item that no part has
        (2, 1, 99, 50.0), (2, 2, 1, 3.0), (2, 3, 2, 50.0), (2, 4, 4, None),  # 2 leads to one of the two of key 4
        (3, 1, 1, None), (3, 2, 2, 1.0), (4, 1, 3, 50.0),
        (5, 1, 1, 49.0), (5, 1, 1, 49.0), (5, 1, 2, 1.0), (None, 1, 1, 50.0), (None, 2, 2, 1.0),
    ]
    items = [(o, n, p, 7, q, "N", "O") for o, n, p, q in rows]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = lambda x: x.rsplit("/", 1)[1].removesuffix(".ts")
    found = sorted((keys(r.src), keys(r.dst)) for r in data.edges(spark, str(tmp_path)).collect())
    assert found == sorted([("2", "3"), ("2", "4"), ("1", "1"), ("1", "2"), ("1", "2")])


@pytest.mark.parametrize("n", [3, 40])
def test_components_without_broadcasts(spark, n, monkeypatch):
    seen = []
    from arcspan.operators import components as module

    whole = module.written
    monkeypatch.setattr(module, "written", lambda df, name: (seen.append(plan(df)), whole(df, name))[1])
    links = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert not any("Broadcast" in p for p in seen)


def test_more_rows_than_a_driver_takes_are_only_counted(spark):
    rows = spark.range(50)
    rows.collect = lambda: pytest.fail("more than the limit were fetched")
    rows.limit = lambda n: spark.range(n)
    assert graph.few(rows, 10) is None


def test_rescans_broadcast_no_table_of_the_project(spark, tmp_path, monkeypatch):
    seen = {}
    whole = session.written
    for module in (session, store, scan):
        monkeypatch.setattr(module, "written", lambda df, name: (seen.setdefault(name, []).append(plan(df)), whole(df, name))[1])
    now = {"src/a.ts": "import { b } from './b'", "src/b.ts": "import { a } from './a'\nimport './c'", "src/c.ts": "const all = import.meta.glob('./x/*.ts')"}
    for change in ({}, {"src/x/d.ts": "import '../a'"}, {"src/b.ts": "import './c'"}):
        now |= change
        store.refreshed(spark, files.in_memory(spark, now), str(tmp_path))
    assert {"changes", "parsed", "links", "altered", "modules", "edges", "probed"} <= seen.keys()
    # buckets of a cache are of a stated number; lifecycle risks are joined by file
    for name in seen.keys() - {"replaced", "lifecycles"}:
        assert not any("Broadcast" in p for p in seen[name]), (name, seen[name])


@pytest.mark.parametrize("framework", ["generic", "vue", "react"])
def test_lifecycle_risks_read_each_file_once(spark, framework):
    texts = files.in_memory(spark, {"a.ts": "onMounted(() => {\n setInterval(f); setTimeout(f) })\nuseEffect(() => { t = setTimeout(f); addEventListener('x', f); setInterval(g) })"})
    found = lifecycle.risks(parse.marked(texts).selectExpr("rel_path AS id", "'client' AS runtime", "marks"), framework)
    text = plan(found)
    assert text.count("MapInArrow") == 1 and "Exchange" not in text and "Join" not in text, text
    want = {"generic": [("event-listener-cleanup", 3), ("timer-cleanup", 2), ("timer-cleanup", 3)], "vue": [("timer-cleanup", 2)], "react": [("event-listener-cleanup", 3), ("timer-cleanup", 3)]}
    assert sorted((r.kind, r.line) for r in found.collect()) == want[framework]
    assert [r.asDict() for r in parse.marked(texts).collect()] == [r.asDict() for r in parse.parse(texts).select("rel_path", "marks").collect()]


def test_edges_on_no_cycle_go_before_groups_are_found(spark, monkeypatch):
    rings, ends = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("o", "o")], [(f"a{k}", "r1") for k in range(9)]
    edges = spark.createDataFrame([(a, b, "static") for a, b in [*rings, *ends, ("r2", "y"), ("y", "z")]], "src string, dst string, kind string")
    given, whole = [], graph.parted
    monkeypatch.setattr(graph, "parted", lambda links, most: (given.append(links), whole(links, most))[1])
    want = {("r1", "r1"), ("r2", "r1"), ("r3", "r1"), ("o", "o")}
    for chunk, left in ((500_000, 15), (3, 4)):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        assert {tuple(r) for r in graph.scc(edges, small=0).collect()} == want
        assert given.pop().count() == left
    pairs = session.written(edges.select("src", "dst"), "pairs")
    assert "Broadcast" not in plan(graph.trimmed(pairs, 2))


def test_lifecycles_of_modules_are_parsed_once(spark, sf, monkeypatch):
    from arcspan.plans import more_queries

    calls, real = spark.sparkContext.accumulator(0), parse._read

    def counted(files, limit, schema, one):
        return real(files, limit, schema, lambda path, text: (calls.add(1), one(path, text))[1])

    monkeypatch.setattr(parse, "_read", counted)
    modules = data.modules(spark, sf)
    risks = more_queries._lifecycles(modules)
    assert risks.count() == risks.select("id", "kind", "line").distinct().count() > 0
    rows = modules.union(modules).hint("merge")
    assert sorted(map(tuple, more_queries._lifecycles(rows).collect())) == sorted(map(tuple, risks.collect()))
    assert calls.value == 2 * modules.where("runtime <> 'server'").count()


def test_matrix_of_a_screen_joins_edges_once(spark):
    from arcspan.plans import views

    edges = [("1", "src/features/a/x.ts", "src/features/b/y.ts"), ("2", "src/features/b/y.ts", "src/features/a/x.ts"), ("0", "src/features/c/z.ts", "src/features/b/y.ts")]
    edges = spark.createDataFrame(edges, "ord string, src string, dst string")
    cycles = spark.createDataFrame([(["src/features/a/x.ts", "src/features/b/y.ts"],)], "modules array<string>")
    bad = spark.createDataFrame([("src/features/c/z.ts", "src/features/b/y.ts", "error")], "src string, dst string, severity string")
    out = views.ui_matrix(edges, cycles, bad)
    text = plan(out)
    assert "ExistingRDD" not in text, text  # all that is left to do is done on cells
    got = {(r.from_place, r.to_place, r.imports, r.violations, r.severity, r.cycle_edges) for r in out.collect()}
    assert got == {(0, 1, 1, 1, "error", 0), (2, 1, 1, 0, "normal", 1), (1, 2, 1, 0, "normal", 1)}
