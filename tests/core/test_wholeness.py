"""Faults that showed on larger tables only: lists cut before they are ranked, jobs made smaller, and loops that move too much."""

import random
from collections import Counter

from arcspan import session
from arcspan.operators import cycles, graph, recommend
from arcspan.plans import views
from arcspan.sources import resolve, typeuse


def test_a_briefing_ranks_all_findings(spark):
    """1,100 findings of one kind above the only one of another: both kinds are in the briefing."""
    rows = [(f"a{k:04}", "many", [f"a{k:04}"], {"n": "1"}, 0.9, 0, f"{k:04}") for k in range(1100)] + [("b", "one", ["b"], {"n": "1"}, 0.2, 1, "0")]
    found = spark.createDataFrame(rows, "id string, kind string, modules array<string>, params map<string,string>, weight double, stage int, seq string")
    none = spark.createDataFrame([], "id string")
    whole = recommend.ranked([found], none, None)
    assert whole.count() == 1101
    assert [(r.id, r.kind) for r in views.briefing(whole.select("id", "kind", "weight"), 6, 2).collect()] == [("a0000", "many"), ("a0001", "many"), ("b", "one")]


def some_links(seed, n=16, m=22):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)}) + [("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("y", "y"), ("z0", "z1")]


def test_groups_in_tasks_agree_with_joins(spark):
    """Components, depths, reach, counts and weak components: on the driver, in tasks that hold whole groups, in groups none can hold."""
    for seed in range(1):
        pairs = some_links(seed)
        e = spark.createDataFrame([(a, b, "static") for a, b in pairs], "src string, dst string, kind string").repartition(5)
        nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {"alone"})], "id string")
        forms = ({}, {"small": 0}, {"small": 0, "most": 3})
        same = lambda found: len({frozenset(Counter(map(tuple, f.collect())).items()) for f in found}) == 1
        members = graph.scc(e)
        assert same([graph.scc(e, **f).select("id", "comp") for f in forms])
        starts, shared = nodes.where("id LIKE '%3' OR id = 'x1'"), nodes.where("id NOT LIKE '%5'")
        for s in (None, starts):
            assert same([graph.depths(nodes, e, members, s, **f).select("id", "depth") for f in forms])
        assert same([graph.reach(e, nodes, **f) for f in forms])
        assert same([graph.reach(e, starts, 2, shared, **f) for f in forms])
        assert same([graph.weak_components(nodes, e, s).select("id", "root") for s in (graph.SMALL, 0)])
        far = Counter((r.id) for r in graph.reach(e, nodes).collect())
        for most in (graph.MOST, 3):
            assert {r.id: r.n for r in graph.reach_counts(e, 1, most).collect()} == dict(far)


def test_blocks_of_bits_meet(spark):
    pairs = [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)] + [("c30", "c20"), ("h", "c05")]
    src, dst = zip(*pairs)
    whole = dict(graph._counts(list(src), list(dst)))
    assert whole == dict(graph._counts(list(src), list(dst), 4)) and whole["c03"] == 3 and whole["c25"] == 31


def test_components_after_erasing_in_tasks(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "g"), ("g", "f"), ("g", "g")]
    e = spark.createDataFrame([(a, b, "static", f"./{b}") for a, b in pairs], "src string, dst string, kind string, specifier string")
    gone = e.where("(src = 'a' AND dst = 'b') OR (src = 'f')")
    for most in (graph.MOST, 1):
        assert {tuple(r) for r in graph.scc_after(e, graph.scc(e), gone, most).collect()} == {("a", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("g", "g")}


def test_prefixes_inside_each_other_give_each_pair_once(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/a/b/y.ts",), ("src/c/z.ts",), ("src/m.ts",)], "rel_path string")
    asked = spark.createDataFrame([("src/m.ts", "./a/"), ("src/m.ts", "./a/b/"), ("src/m.ts", "./a/"), ("src/a/x.ts", "./")], "src string, prefix string")
    got = sorted(tuple(r) for r in resolve.expanded_prefixes(asked, files).collect())
    assert got == [("src/a/x.ts", "src/a/b/y.ts"), ("src/m.ts", "src/a/b/y.ts"), ("src/m.ts", "src/a/x.ts")]


def test_all_signals_of_a_rule_reach_the_review(spark, sf, monkeypatch):
    """1,300 violations of one rule: a review counts them all, where a list of 1,000 left 300 out (F8)."""
    from arcspan.plans import more_queries

    found = [(f"boundary:r:{k}", "r", "error", f"src/app/a{k}.ts", "src/core/b.ts", "./b", f"{k:05}") for k in range(1300)]
    found = spark.createDataFrame(found, "id string, rule string, severity string, src string, dst string, specifier string, ord string")
    assert recommend.from_contracts(found, None).count() == 1300 and recommend.from_contracts(found, 1000).count() == 1000
    given, whole = [], views.review_parts
    monkeypatch.setattr(more_queries.rules, "boundary_violations", lambda edges, rules: found)
    monkeypatch.setattr(more_queries.views, "review_parts", lambda *a: (given.append(a), whole(*a))[1])
    more_queries.review_risk(spark, sf)
    assert given[0][4].count() == 1300


def test_large_groups_are_reached_in_few_rounds(spark, monkeypatch):
    """A chain of 14 with branches and a loop in a group no task can hold: as many rounds as its length has binary digits, not one a step."""
    pairs = [(f"c{k:02}", f"c{k + 1:02}") for k in range(14)] + [("c05", "b0"), ("b0", "b1"), ("b1", "c08"), ("c05", "a0"), ("a0", "b1"), ("c14", "c12"), ("c03", "c03")]
    e = spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    through = nodes.where("id <> 'b0' AND id NOT LIKE '%9'")
    rounds, whole = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), whole(df, name))[1])
    for depth, passing in ((None, through), (7, None)):
        want = Counter(map(tuple, graph.reach(e, nodes, depth, passing, most=graph.MOST).collect()))
        rounds.clear()
        assert Counter(map(tuple, graph.reach(e, nodes, depth, passing, small=0, most=3).collect())) == want
        assert 0 < rounds.count("balls") <= 6 and "reach" not in rounds
    assert graph.reach(e, nodes, small=0, most=3, ways=False).columns == ["source", "id", "distance"]
    far = Counter(r.id for r in graph.reach(e, nodes).collect())
    for dense in (graph.DENSE, 1):  # pairs, bits
        monkeypatch.setattr(graph, "DENSE", dense)
        rounds.clear()
        assert {r.id: r.n for r in graph.reach_counts(e, 1, 3).collect()} == dict(far)
        assert ("bits" in rounds) == (dense == 1)


def test_components_share_tasks_and_rings_are_read_at_once(spark, monkeypatch):
    r = random.Random(3)
    for n in (*range(2, 24), 40):
        names = r.sample(range(100, 999), n)
        pairs = {(f"m{a}", f"m{b}") for a, b in zip(names, [*names[1:], names[0]])}
        one = cycles._reading("c", pairs)
        with monkeypatch.context() as m:
            m.setattr(cycles, "ring", lambda pairs, members: None)
            assert cycles._reading("c", pairs) == one
    ordered = sorted(["a", "b", "c", "d"])
    assert cycles.ring({("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}, ordered) is None and cycles.ring({("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")}, ordered) is None
    assert cycles.ring({("a", "a")}, ["a"]) is None and cycles.ring({("a", "b"), ("b", "a"), ("a", "a")}, ["a", "b"]) is None
    edges = [(f"{c}{k}", f"{c}{(k + 1) % 3}", "static") for c in "abcdefgh" for k in range(3)]
    e = spark.createDataFrame([*edges, ("a0", "a1", "static"), ("a1", "a0", "dynamic")], "src string, dst string, kind string").repartition(5)
    found = cycles.explained(e, graph.scc(e))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.comp, x.src, x.dst, x.total_cycles) for x in found.collect()) == [("a0", "a0", "a1", 2), *((f"{c}0", f"{c}2", f"{c}0", 1) for c in "bcdefgh")]


def test_texts_that_are_alike_are_read_once(monkeypatch):
    calls, whole = [], typeuse.Reading
    monkeypatch.setattr(typeuse, "Reading", lambda code: (calls.append(code), whole(code))[1])
    text = "import { Alike } from './m'\nlet a: Alike | null = null"
    for k in range(5):
        assert typeuse.type_only_names(f"r{k}/m.ts", text, "./m") == ["Alike"]
    assert len(calls) == 1 and typeuse.type_only_names("x.vue", text, "./m") == []


def test_rings_stay_as_they_lie(spark, monkeypatch):
    """Of rings nothing can be trimmed: their edges aren't shuffled before groups are found, so groups are whole in their chunks."""
    rings = session.written(spark.createDataFrame([(f"r{c}/{k}", f"r{c}/{(k + 1) % 4}", "static") for c in range(30) for k in range(4)], "src string, dst string, kind string"), "rings")
    given, whole = [], graph.parted
    monkeypatch.setattr(graph, "CHUNK", 50)
    monkeypatch.setattr(graph, "parted", lambda links, most: (given.append(links), whole(links, most))[1])
    assert sorted(map(tuple, graph.scc(rings, small=0).collect())) == sorted((f"r{c}/{k}", f"r{c}/0") for c in range(30) for k in range(4))
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString() and given[0].inputFiles() == rings.inputFiles()
