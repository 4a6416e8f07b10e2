"""Queries over all modules and line items, against brute force."""

import random
from collections import Counter, defaultdict, deque

import __spark_entry__ as entry
from arcspan.adapters import testdata as data
from arcspan.operators import graph as graph_ops


def ways(edges, depth=None):
    """``(source, id)`` to the distance, for all sources."""
    out = {}
    for source in list(edges):
        seen, queue = {source: 0}, deque([source])
        while queue:
            at = queue.popleft()
            for to in edges[at] if at in edges and (depth is None or seen[at] < depth) else ():
                if to not in seen:
                    seen[to] = seen[at] + 1
                    queue.append(to)
        out |= {(source, k): n for k, n in seen.items()}
    return out


def graph(spark, sf):
    ids = [r.id for r in data.modules(spark, sf).collect()]
    down, up = defaultdict(set), defaultdict(set)
    for r in data.edges(spark, sf).collect():
        down[r.src].add(r.dst)
        up[r.dst].add(r.src)
    return ids, down, up


def test_reach_of_every_module(spark, sf):
    ids, down, up = graph(spark, sf)
    want = {k for k in ways(up) if k[0] in ids and k[0] != k[1]}
    assert {tuple(r) for r in entry.queries()["transitive_importers"](spark, sf).collect()} == want
    far = defaultdict(lambda: 9)
    for found in (ways(up, 3), ways(down, 3)):
        for k, n in found.items():
            far[k] = min(far[k], n)
    want = {(*k, n) for k, n in far.items() if n and k[0] in ids}
    assert sorted(map(tuple, entry.queries()["bounded_impact"](spark, sf).collect())) == sorted(want)


def test_importers_of_every_module(spark, sf):
    ids, _, up = graph(spark, sf)
    n = Counter(s for s, i in ways(up) if s != i)
    assert {r.id: r.importers for r in entry.queries()["importer_counts"](spark, sf).collect()} == {i: n[i] for i in ids}


def test_counts_by_bits(spark):
    """Chains, circles, hubs, loops and repeated links, with more sources than a row has bits."""
    r = random.Random(4)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "c4"), ("x", "x"), ("a", "b"), ("a", "b")] + [(f"h{k:03}", "hub") for k in range(150)] + [("hub", "c0")]
    pairs += [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(70)]
    down = defaultdict(set)
    for a, b in pairs:
        down[a].add(b)
    want = Counter(i for s, i in ways(down) if s != i)
    got = {x.id: x.n for x in graph_ops.reach_counts(spark.createDataFrame(pairs, "src string, dst string"), words=1).collect()}
    assert got == dict(want)


def test_risk_of_every_module(spark, sf):
    ids, _, up = graph(spark, sf)
    n = Counter(s for s, i in ways(up) if s != i)
    got = entry.queries()["impact_risk"](spark, sf).collect()
    assert sorted(r.source for r in got) == sorted(ids)
    assert all(r.affected == n[r.source] for r in got)


def test_prefixes_of_every_module(spark, sf):
    ids, *_ = graph(spark, sf)
    want = {(a, b) for a in ids for b in ids if a != b and a.split("/")[:3] == b.split("/")[:3]}
    assert {tuple(r) for r in entry.queries()["prefix_expansion"](spark, sf).collect()} == want


def test_log_of_all_line_items(spark, sf):
    want = defaultdict(lambda: [0, 0, 0])
    for r in data.table(spark, sf, "lineitem").collect():
        moved = r.l_linenumber % 4 == 0
        at = want["a@x.org", f"src/{'new/' if moved else ''}{r.l_partkey}.ts", f"src/old/{r.l_partkey}.ts" if moved else None]
        at[0] += 1
        at[1] += 0 if r.l_linenumber == 5 else int(r.l_quantity)
        at[2] += r.l_suppkey
    got = {(r.author, r.path, r.renamed_from): [r.n, r.added or 0, r.removed] for r in entry.queries()["git_log"](spark, sf).collect()}
    assert got == dict(want)
