"""Operators on small hand-made graphs, and both forms of each algorithm."""

import random

import pytest
from pyspark.sql import functions as F

from arcspan.functions.globs import glob_regex, ignore_regex, ignored
from arcspan.functions.values import fnv1a, half_up
from arcspan.operators import bundle, cycles, diff, graph, history, metrics, recommend, rules
from arcspan.plans import views
from arcspan.sources import files


def edges(spark, pairs, kind="static"):
    return spark.createDataFrame([(f"{k:05d}", a, b, kind, f"./{b}", True) for k, (a, b) in enumerate(pairs)] or [], "ord string, src string, dst string, kind string, specifier string, resolved boolean")


def modules(spark, names):
    return spark.createDataFrame([(n, "module", "ts", 10 * (k + 1), 0, False, "shared", False, k) for k, n in enumerate(names)], "id string, kind string, language string, loc long, n_exports long, is_infra boolean, runtime string, is_server_actions boolean, ord long")


def closure(pairs):
    reach = {}
    for a, b in pairs:
        reach.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}
    out = {n: set() for n in nodes}
    for n in nodes:
        todo = list(reach.get(n, ()))
        while todo:
            m = todo.pop()
            if m not in out[n]:
                out[n].add(m)
                todo += reach.get(m, ())
    return out


def some_graph(seed, n=14, m=20):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)})


@pytest.mark.parametrize("pairs, want", [
    ([("a", "b"), ("b", "a")], {"a": "a", "b": "a"}), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], {"a": "a", "b": "a", "c": "a"}), ([("a", "a")], {"a": "a"}), ([("a", "b")], {}), ([], {}),
])
def test_components(spark, pairs, want):
    for small in (graph.SMALL, 0):
        if pairs or small:
            assert {r.id: r.comp for r in graph.scc(edges(spark, pairs), small).collect()} == want


def test_type_only_edges_make_no_cycle(spark):
    both = edges(spark, [("a", "b")]).union(edges(spark, [("b", "a")], "type-only"))
    assert graph.scc(both).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_both_forms_agree(spark, seed):
    pairs = some_graph(seed)
    reach = closure(pairs)
    want = {n: min(m for m in reach if m == n or (m in reach[n] and n in reach[m])) for n in reach if n in reach[n]}
    e = edges(spark, pairs)
    for small in (graph.SMALL, 0):
        assert {r.id: r.comp for r in graph.scc(e, small).collect()} == want
    m = modules(spark, sorted({x for p in pairs for x in p}))
    members = graph.scc(e)
    got = [{r.id: r.depth for r in graph.depths(m, e, members, small=s).collect()} for s in (graph.SMALL, 0)]
    assert got[0] == got[1]


def test_reach_forms(spark, monkeypatch):
    pairs = some_graph(9)
    e, s = edges(spark, pairs), spark.createDataFrame([("n01",), ("n05",)], "id string")
    first = sorted(graph.reach(e, s, 2).collect())
    whole = {(r.source, r.id) for r in graph.reach(e, s).collect()}
    assert whole == {(a, b) for a in ("n01", "n05") for b in closure(pairs).get(a, ()) if b != a}
    monkeypatch.setattr(graph, "SMALL", 0)
    assert sorted(graph.reach(e, s, 2).collect()) == first
    assert {(r.source, r.id) for r in graph.reach(e, s).collect()} == whole


def test_weak_forms(spark, monkeypatch):
    pairs = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")]
    m = modules(spark, list("abcdefg"))
    want = dict(zip("abcdefg", "aaaddfg"))
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        assert {r.id: r.root for r in graph.weak_components(m, edges(spark, pairs)).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_feedback_leaves_no_cycle(seed):
    pairs = set(some_graph(seed, 9, 24))
    members = sorted({x for p in pairs for x in p})
    back = cycles.feedback(pairs, members)
    assert not graph.tarjan(list(pairs - back))
    found, cut = cycles.elementary(pairs, members)
    assert not cut and len({tuple(c) for c in found}) == len(found)
    assert all(set(zip(c, [*c[1:], c[0]])) <= pairs and c[0] == min(c) and len(set(c)) == len(c) for c in found)
    assert len(found) == brute_cycles(pairs, members)


def brute_cycles(pairs, members):
    def walk(start, at, seen):
        return sum(1 if b == start else walk(start, b, seen | {b}) for a, b in pairs if a == at and (b == start or (b > start and b not in seen)))

    return sum(walk(m, m, {m}) for m in members)


def test_cycle_shapes(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("x/index.ts", "x/one.ts"), ("x/one.ts", "x/index.ts"), ("x/one.ts", "x/two.ts"), ("x/two.ts", "x/index.ts")])
    rows = cycles.explained(e, graph.scc(e)).collect()
    assert {r.comp: r.pattern for r in rows} == {"a": "mutual-pair", "x/index.ts": "barrel-cycle"}
    assert sum(r.breakpoint for r in rows) == 2 and all(not r.partial for r in rows)
    chain = [(f"m{k:02d}", f"m{(k + 1) % 12:02d}") for k in range(12)]
    e = edges(spark, chain)
    assert {r.pattern for r in cycles.explained(e, graph.scc(e)).collect()} == {"long-chain"}


def test_simple_paths_and_limits():
    pairs = {("s", "a"), ("a", "t"), ("s", "b"), ("b", "t"), ("a", "b")}
    assert cycles.simple_paths(cycles.followers(pairs), "s", "t") == (3, False)
    assert cycles.simple_paths(cycles.followers(pairs), "s", "t", paths=2) == (2, True)


def test_parallel_edges_count(spark):
    m = {r.id: (r.fan_in, r.fan_out) for r in metrics.fans(modules(spark, ["a", "b"]), edges(spark, [("a", "b"), ("a", "b")])).collect()}
    assert m == {"a": (0, 2), "b": (2, 0)}


def test_empty_graph(spark):
    e, m = edges(spark, []), modules(spark, ["a"])
    members = graph.scc(e)
    mm = metrics.module_metrics(m, e, members, graph.depths(m, e, members))
    assert mm.first().hotness == 0 and metrics.hot_zones(mm).count() == 0
    assert metrics.arch_debt(mm, graph.cycles(members), rules.layer_violations(m, e), metrics.hot_zones(mm)).first().grade == "A"


def test_rounding(spark):
    got = spark.createDataFrame([(0.0005,), (1.0045,), (-0.0005,)], "x double").select(half_up(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.001, 1.004 if 1.0045 * 1000 + 0.5 < 1005 else 1.005, 0.0]


def test_hash_of_names():
    assert fnv1a("") == "811c9dc5" and fnv1a("a") == "e40c292c" and fnv1a("foobar") == "bf9cf968"


@pytest.mark.parametrize("pattern, yes, no", [
    ("src/core/**", ["src/core/a.ts", "src/core/x/y.ts"], ["src/core", "src/corex/a.ts"]), ("*.vue", ["a.vue", "x/y.vue"], ["a.vue.ts"]), ("/a.ts", ["a.ts"], ["x/a.ts"]), ("build/", ["build/x", "a/build/y"], ["build"]),
    ("a/*/c", ["a/b/c", "a/b/c/d"], ["a/b/x/c"]), ("**/t.ts", ["t.ts", "a/b/t.ts"], ["at.ts"]), ("f?o", ["foo", "x/fao/z"], ["f/o"]), ("[ab].ts", ["a.ts"], ["c.ts"]),
])
def test_ignore_patterns(spark, pattern, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string").select(ignored(F.col("p"), pattern)).collect()
    assert [r[0] for r in rows] == [True] * len(yes) + [False] * len(no)


def test_negated_patterns_and_globs(spark):
    rows = spark.createDataFrame([("a/x.ts",), ("a/y.ts",)], "p string").select(ignored(F.col("p"), ["a/**", "!a/y.ts", "# no"])).collect()
    assert [r[0] for r in rows] == [True, False]
    assert glob_regex("src/**/a?.ts") == r"^src/(?:.*/)?a[^/]\.ts$" and ignore_regex("") is None


def test_layers(spark):
    names = ["src/app/a.ts", "app/a.ts", "src/src/core/x.ts", "lib/app/a.ts", "src/x.ts", "core"]
    got = [r[0] for r in modules(spark, names).orderBy("ord").select(rules.layer(F.col("id"), {"lib/**": "shared", "x": "nonsense"})).collect()]
    assert got == ["app", "app", "core", "shared", "unknown", "core"]
    e = edges(spark, [("src/core/a.ts", "src/app/b.ts"), ("src/shared/a.ts", "src/features/b.ts"), ("src/app/b.ts", "src/core/a.ts")])
    m = modules(spark, ["src/core/a.ts", "src/app/b.ts", "src/shared/a.ts", "src/features/b.ts"])
    assert sorted(r.severity for r in rules.layer_violations(m, e).collect()) == ["error", "warning"]


def test_gates():
    assert rules.parse_gate("cycles:any") == ("cycles", ">", 0) and rules.parse_gate("grade:c") == ("grade", ">=", "C") and rules.parse_gate("cycles:>3") == ("cycles", ">", 3)
    assert rules.parse_gate("signals:High") == ("signals-high", ">", 0) and rules.parse_gate("bundle-bloat:low") == ("bundle-bloat-low", ">", 0)
    for bad in ("cycles", "grade:Z", "nothing:1", "cycles:x", "signals:3", "bundle-bloat:critical"):
        with pytest.raises(ValueError):
            rules.parse_gate(bad)


def test_gates_fail_above_their_count(spark):
    one = spark.createDataFrame([("B", 0, 2, 1)], "grade string, cycles long, layer_violations long, signals_high long")
    got = {r.gate: r.failed for r in rules.gates(one, ["grade:C", "grade:B", "cycles:0", "cycles:any", "layer-violations:2", "layer-violations:1", "layer-violations:>=2", "signals:high"]).collect()}
    assert got == {"grade:C": False, "grade:B": True, "cycles:0": False, "cycles:any": False, "layer-violations:2": False, "layer-violations:1": True, "layer-violations:>=2": True, "signals:high": True}


def test_impact_counts_the_target_alone(spark):
    # d imports c imports b imports a; b and c are a cycle, d breaks a layer rule twice
    target = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    importers = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "b"), ("b", "c"), ("b", "d")], "source string, id string")
    members = spark.createDataFrame([("b", "b"), ("c", "b")], "id string, comp string")
    bad = spark.createDataFrame([("e1", 1, "d", "c"), ("e2", 2, "d", "x")], "edge_id string, ord long, src string, dst string")
    got = {r.source: (r.affected, r.cycles, r.violations, r.risk) for r in views.impact(target, importers, members, bad).collect()}
    assert got == {"a": (3, 0, 0, "medium"), "b": (2, 1, 0, "high"), "d": (0, 0, 2, "high")}


def test_risk_counts_contracts_once_a_module(spark):
    m = spark.createDataFrame([("src/a.ts", 1.0, 2.0, 1, 1), ("src/b.ts", 0.0, 0.0, 0, 0)], "id string, hotness double, coupling double, fan_in long, fan_out long")
    pairs = lambda *x: spark.createDataFrame(x, "src string, dst string")
    got = {r.id: (r.violation_count, r.risk) for r in views.module_risk(m, spark.createDataFrame([("src/b.ts", "x")], "id string, comp string"), pairs(("src/a.ts", "src/b.ts")), pairs(("src/a.ts", "src/a.ts"), ("src/b.ts", None)), m.where("fan_in = 1")).collect()}
    assert got == {"src/a.ts": (2, 1 + 2 + 1 + 1 + 20 + 10), "src/b.ts": (2, 12 + 20)}
    found = views.finding_modules(spark.createDataFrame([("h",)], "id string"), spark.createDataFrame([("c",)], "id string"), pairs(("v", "w")), pairs(("x", "w"), ("y", None)))
    assert sorted(r.id for r in found.collect()) == ["c", "h", "v", "w", "x", "y"]


def test_review_risk_by_hand(spark):
    names = "debt double, direct_cycles long, layer_errors long, contract_errors long, ci_signals long, hot_zones long, lifecycle_owners long, lifecycle_risks long, new_cycles long, resolved_cycles long, new_signals long, regressed_signals long, resolved_signals long"
    row = lambda *x: tuple(views.review_risk(spark.createDataFrame([x], names)).first())[1:]
    assert row(10.0, 1, 0, 0, 0, 3, 1, 2, 0, 0, 0, 0, 0) == (10 + 12 + 6 + 18, "medium")
    assert row(0.0, 0, 1, 1, 1, 20, 2, 5, 1, 1, 1, 1, 1) == (10 + 10 + 8 + 15 + 22 + 15 + 5 + 10 - 9, "critical")
    assert row(0.0, 0, 0, 0, 0, 0, 0, 0, 0, 9, 0, 0, 9) == (0, "low")


def test_what_discovery_leaves_out(spark):
    want = {
        "src/a.ts": None, "src/app.config.ts": None, "vite.config.mts": "config", "x/eslint.config.js": "config", "test/a.ts": None, "tests/a.ts": None, "src/__fixtures__/a.ts": None, ".vercel/a.ts": None, "out/a.ts": "dir", ".idea/a.ts": "dir",
        ".vscode/a.js": "dir", "a/__snapshots__/b.ts": "test", ".storybook/main.ts": "test", "e2e/a.ts": "test", "a.spec.mts": "test", "B.stories.vue": "story", "b.stories.tsx": "story", "b.story.ts": None, "a.d.ts": "types", "a.d.cts": "types",
    }
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", files.skipped(F.col("path")).alias("why")).collect()
    assert {r.path: r.why for r in rows} == want


def test_coupling(spark):
    rows = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "b"), ("4", "a"), ("5", "c")]
    changes = spark.createDataFrame([(s, p, None, 1, None) for s, p in rows], "sha string, path string, renamed_from string, added long, removed long")
    got = history.temporal_coupling(modules(spark, ["a", "b", "c"]), edges(spark, []), changes).collect()
    assert [(r.a, r.b, r.co, r.score, r.hidden) for r in got] == [("a", "b", 3, 0.75, True)]
    assert history.temporal_coupling(modules(spark, ["a", "b"]), edges(spark, []), changes, fan_out_cap=1).count() == 0


def test_churn_charges_both_names_and_groups_authors(spark):
    commits = spark.createDataFrame([(str(k), f"u{k}", f"2024-01-0{k + 1}") for k in range(8)], "sha string, author string, authored_at string")
    changes = spark.createDataFrame([(str(k), "b", "a" if k == 0 else None, 1, None) for k in range(8)], "sha string, path string, renamed_from string, added long, removed long")
    got = {r.id: r for r in history.churn(modules(spark, ["a", "b"]), commits, changes).collect()}
    assert got["a"].commits == 1 and got["b"].commits == 8 and got["b"].author_count == 8 and got["b"].authors.endswith("__other__=3") and got["b"].last_touched_at == "2024-01-08"


def test_diff_of_equal_scans_is_empty(spark):
    m = modules(spark, ["a", "b"])
    assert diff.modules(m, m).count() == 0 and diff.keyed(m, m, "id", "x").count() == 0


def test_lifecycle(spark):
    s = lambda rows: spark.createDataFrame(rows, "stable_key string, severity string, confidence string")
    got = recommend.lifecycle(s([("a", "low", "high"), ("b", "high", "high"), ("c", "low", "low")]), s([("a", "high", "high"), ("b", "low", "high"), ("d", "low", "low")])).collect()
    assert {r.stable_key: r.status for r in got} == {"a": "regressed", "b": "existing", "c": "resolved", "d": "new"}


def test_suppressions(spark):
    rows = spark.createDataFrame([("1", "k", ["m"]), ("2", "k", ["n"]), ("3", "z", ["m"])], "id string, stable_key string, modules array<string>")
    sup = spark.createDataFrame([("k", "m", None), ("z", None, "2020-01-01"), ("gone", None, None)], "stable_key string, module string, expires string")
    assert {r.id: r.suppressed for r in recommend.suppress(rows, sup, "2024-01-01").collect()} == {"1": True, "2": False, "3": False}
    assert [r.stable_key for r in recommend.stale(sup, rows).collect()] == ["gone"]


def test_bundle_paths_and_trees(spark):
    names = ["./src/a.ts?x=1", "!!loader!./b.ts", "C:\\p\\src\\c.ts", "/root/app/src/d.ts"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(bundle.normal_path(F.col("n"), "/root/app")).collect()]
    assert got == ["src/a.ts", "b.ts", "C:/p/src/c.ts", "src/d.ts"]
    tree = {"name": "root", "children": [{"name": "a", "children": [{"name": "x.js", "value": 3}]}, {"name": "y.js", "value": 4}]}
    assert bundle.rollup_leaves(tree) == [("root/a/x.js", 3), ("root/y.js", 4)]


def test_runtime_leaks(spark):
    rows = [("c", "client"), ("h", "shared"), ("s", "server"), ("t", "server"), ("d", "client")]
    m = spark.createDataFrame([(n, r, False) for n, r in rows], "id string, runtime string, is_server_actions boolean")
    got = {(r.src, r.dst, r.direct) for r in graph.runtime_leaks(m, edges(spark, [("c", "h"), ("h", "s"), ("d", "t"), ("s", "t")])).collect()}
    assert got == {("c", "s", False), ("d", "t", True)}


def plain_order(pairs, members):
    """The order as it is defined, sweep by sweep over lists."""
    out = {m: {b for a, b in pairs if a == m and b != m} for m in members}
    into = {m: {a for a, b in pairs if b == m and a != m} for m in members}
    left, head, tail = list(members), [], []

    def take(v):
        left.remove(v)
        for w in out.pop(v):
            into[w].discard(v)
        for w in into.pop(v):
            out[w].discard(v)

    while left:
        moved = True
        while moved:
            moved = False
            for edges, to in ((out, tail), (into, head)):
                for v in list(left):
                    if not edges[v]:
                        to.append(v)
                        take(v)
                        moved = True
        if left:
            head.append(min(left, key=lambda v: (len(into[v]) - len(out[v]), v)))
            take(head[-1])
    return head + tail[::-1]


def test_vertex_order_is_the_plain_one():
    import random

    r = random.Random(3)
    for _ in range(400):
        names = sorted({f"m{r.randrange(100):02}" for _ in range(r.randrange(1, 14))})
        pairs = {(r.choice(names), r.choice(names)) for _ in range(r.randrange(3 * len(names)))}
        assert cycles.vertex_order(pairs, names) == plain_order(pairs, names)


def test_a_ring_of_many_is_linear():
    import time

    names = [f"n{k:06}" for k in range(100_000)]
    pairs = set(zip(names, names[1:] + names[:1]))
    began = time.time()
    back = cycles.feedback(pairs, names)
    assert back == {(names[-1], names[0])} and cycles.broken(pairs, names, back) == ({(names[-1], names[0]): (1, False)}, -1)
    assert time.time() - began < 20
