"""Graph algorithms over edge tables ``(src, dst)``.

Weakly connected groups of edges are independent: they are dealt to tasks (see
:mod:`.parts`), which work in memory of a stated bound. Groups beyond it have
a form whose loops are joins, with each round written to the shared folder, so
nothing grows on the driver. Below ``SMALL`` edges (the count is taken first, on
the edges that matter) the same result is computed in memory: dozens of small
jobs would cost more than the work.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .parts import CHUNK, MOST, by_part, parted, roots

SMALL, WALKS = 200_000, 50_000_000
REPEATS, DENSE = 16, 256  # what a doubling round may meet for each pair known; pairs a node up to which counts are taken from them


def live(edges: DataFrame) -> DataFrame:
    """Edges that exist at run time."""
    return edges.where(F.col("kind") != "type-only")


def few(df: DataFrame, limit: int) -> list | None:
    """The rows, if there are no more than ``limit``; they are counted first, so more never reach the driver."""
    return df.collect() if df.limit(limit + 1).count() <= limit else None


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- strongly connected components -------------------------------------------


def tarjan(pairs: list[tuple]) -> list[list]:
    """Components of two and more nodes or with a loop, each sorted; without recursion."""
    out, loops = defaultdict(list), {a for a, b in pairs if a == b}
    for a, b in sorted(set(pairs)):
        out[a].append(b)
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    found = []
    for root in sorted({x for p in pairs for x in p}):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1 or v in loops:
                        found.append(sorted(group))
    return found


def trimmed(pairs: DataFrame, rounds: int) -> DataFrame:
    """Without edges that begin where none ends or end where none begins: they lie on no cycle."""
    for _ in range(rounds):
        ends, starts = pairs.select(F.col("dst").alias("src")).distinct().hint("merge"), pairs.select(F.col("src").alias("dst")).distinct().hint("merge")
        pairs = pairs.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")
    return pairs


def pruned(pairs: DataFrame) -> DataFrame:
    """Without most edges that lie on no cycle: trimmed while more than a chunk is left and a fifth of it goes.

    What is left falls into smaller groups, of which fewer are found in parts.
    Where nearly all nodes have edges both ways (estimated) there is little to
    trim; then the edges stay as they lie, as those that lie together may belong together.
    """
    n = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode(F.array("src", "dst")).alias("x"))
    one = n.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(c, 0.02).alias(c) for c in ("a", "b", "x"))).first()
    before = one.n // 2
    if before > CHUNK and min(one.a, one.b) > 0.9 * one.x:
        return pairs
    while before > CHUNK:
        pairs = written(trimmed(pairs, 2), "pruned")
        after = pairs.count()
        if after > 0.8 * before:
            break
        before = after
    return pairs


def _grouped(src: list, dst: list):
    """``(id, comp)`` of the components of some links."""
    return ((m, g[0]) for g in tarjan(list(zip(src, dst))) for m in g)


def scc(edges: DataFrame, small: int = SMALL, most: int = MOST) -> DataFrame:
    """``(id, comp)`` of all modules on cycles; ``comp`` is the smallest of a component."""
    spark = edges.sparkSession
    pairs = live(edges).select("src", "dst")  # read twice: counted, then collected or dealt
    schema = "id {0}, comp {0}".format(pairs.schema["src"].dataType.simpleString())
    rows = few(pairs, small)
    if rows is not None:
        return _frame(spark, list(_grouped([r.src for r in rows], [r.dst for r in rows])), schema)
    own, large = parted(pruned(pairs), most)
    found = by_part(own, _grouped, schema)
    return written(found if large is None else found.union(_scc_by_joins(large.distinct(), schema, small)), "scc").hint("merge")


def _scc_by_joins(pairs: DataFrame, schema: str, small: int) -> DataFrame:
    """:func:`scc` of a group that no task can hold; what few edges trimming leaves are searched in memory."""
    spark = pairs.sparkSession
    loops = pairs.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("comp"))
    rest = written(pairs.where("src <> dst"), "scc")
    found = []
    while True:
        before = rest.count()
        rest = written(trimmed(rest, 2), "scc")
        after = rest.count()
        if after <= small:
            last = rest.collect()
            found.append(_frame(spark, list(_grouped([r.src for r in last], [r.dst for r in last])), schema))
            break
        if after < 0.95 * before:
            continue
        # each node takes the smallest node that reaches it; its component is what also reaches that node
        colour = written(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")), "scc")
        while True:
            handed = rest.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            again = written(colour.join(handed, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "scc")
            colour = again.select("id", "c")
            if not again.where("moved").limit(1).count():
                break
        same = written(rest.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").select("src", "dst", "c"), "scc")
        front = reached = colour.where("id = c")
        while front.limit(1).count():
            front = written(same.join(front.select(F.col("id").alias("dst"), F.col("c").alias("k")), "dst").where("c = k").select(F.col("src").alias("id"), "c").distinct().join(reached, ["id", "c"], "left_anti"), "scc")
            reached = written(reached.union(front), "scc")
        found.append(reached.select("id", F.col("c").alias("comp")))
        gone = reached.select("id")
        rest = written(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    whole = _frame(spark, [], schema)
    for x in found:
        whole = whole.union(x)
    sizes = whole.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    whole = whole.join(sizes.where("n > 1").select("comp"), "comp").select("id", "comp")
    return whole.union(loops.join(whole, "id", "left_anti").select("id", "comp"))


def without(edges: DataFrame, erased: DataFrame) -> DataFrame:
    """Edges but for those erased (``src, dst, specifier``); edges of types stay, as they count for no cycle anyway."""
    typed, rest = edges.where("kind = 'type-only'"), edges.where("kind <> 'type-only'")
    return rest.join(erased.select("src", "dst", "specifier").distinct(), ["src", "dst", "specifier"], "left_anti").select(*edges.columns).union(typed)


def scc_after(edges: DataFrame, members: DataFrame, erased: DataFrame, most: int = MOST) -> DataFrame:
    """Members of the components of ``edges`` once ``erased`` are gone, from those before.

    Erasing splits components and never joins them, so only a component that
    loses an edge of its own is searched again, inside its own edges; all
    others are carried over. Components are dealt to tasks whole, but for those
    of more than ``most`` edges.
    """
    at = lambda side: members.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    hit = erased.join(at("src"), "src").join(at("dst"), "dst").where("src_comp = dst_comp").select(F.col("src_comp").alias("comp"))
    hit = written(hit.distinct(), "hit")
    inside = cycle_edges(without(edges, erased), members).join(hit, "comp", "left_semi")
    inside = written(inside.select("src", "dst", F.col("comp").alias("root")), "inside")
    large = written(inside.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root"), "large")
    schema = "id {0}, comp {0}".format(inside.schema["src"].dataType.simpleString())
    if large.isEmpty():
        again = by_part(inside, _grouped, schema)
    else:
        again = by_part(inside.join(large, "root", "left_anti").select("src", "dst", "root"), _grouped, schema)
        again = again.union(scc(inside.join(large, "root", "left_semi").withColumn("kind", F.lit("static")), most=most).select("id", "comp"))
    return members.join(hit, "comp", "left_anti").select("id", "comp").union(again)


def cycles(members: DataFrame) -> DataFrame:
    """``comp, length, severity, modules`` from :func:`scc`; members sorted."""
    rows = members.groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("modules"))
    length = F.size("modules").cast("long")
    return rows.select("comp", length.alias("length"), F.when(length <= 2, "direct").otherwise("indirect").alias("severity"), "modules")


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``src, dst, specifier`` with both ends in one component."""
    at = lambda side: members.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    return live(edges).join(at("src"), "src").join(at("dst"), "dst").where("src_comp = dst_comp").select("src", "dst", "specifier", F.col("src_comp").alias("comp")).distinct()


# --- depth ---------------------------------------------------------------------


def condensed(modules: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, comp)`` of all modules and distinct edges between components of two and more."""
    large = members.join(members.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp"), "comp").select("id", "comp")
    comp = modules.select("id").join(large, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    at = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    links = live(edges).join(at("src"), "src").join(at("dst"), "dst").where("src_comp <> dst_comp").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")).distinct()
    return comp, links


def depths(modules: DataFrame, edges: DataFrame, members: DataFrame, entries: DataFrame | None = None, small: int = SMALL, most: int = MOST) -> DataFrame:
    """``(id, depth)``: the longest path over components from those of entries, else from those that nothing leads to.

    Components that a loop of the links leaves without an order (the members
    given may miss one) have depth 0, and so has what only they lead to.
    """
    comp, links = condensed(modules, edges, members)
    kind = comp.schema["id"].dataType.simpleString()
    starts = None if entries is None else entries.select("id").join(comp, "id").select(F.col("comp").alias("id")).distinct()
    rows = few(links, small) if live(edges).limit(small + 1).count() <= small else None
    if rows is not None:
        given = None if starts is None else {r.id for r in starts.collect()}
        dist = longest([(r.src, r.dst) for r in rows], given or None)
        found = _frame(edges.sparkSession, list(dist.items()), f"comp {kind}, depth int")
        return comp.join(found, "comp", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))
    comp, links = written(comp, "comp").hint("merge"), written(links, "depth")
    if starts is not None:
        starts = written(starts, "starts").hint("merge")
        starts = None if starts.isEmpty() else starts
    own, large = parted(links, most)
    given = starts is not None
    for side in ("src", "dst") if given else ():
        own = own.join(starts.select(F.col("id").alias(side), F.lit(1).alias(f"{side}_starts")), side, "left")

    def deep(src, dst, *marks):
        first = {x for side, mark in zip((src, dst), marks) for x, m in zip(side, mark) if m} if given else None
        return longest(list(zip(src, dst)), first).items()

    dist = by_part(own.select("src", "dst", *(("src_starts", "dst_starts") if given else ()), "root"), deep, f"id {kind}, depth int")
    if large is not None:
        within = written(large, "depth")
        nodes = within.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        dist = dist.union(_depths_by_joins(nodes, within, starts if starts is None else starts.join(nodes, "id", "left_semi")))
    dist = written(dist, "depth").hint("merge")
    return comp.join(dist.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def _depths_by_joins(nodes: DataFrame, links: DataFrame, starts: DataFrame | None) -> DataFrame:
    """``(id, depth)`` of nodes of groups that no task can hold."""
    order = nodes
    while True:  # what has no place in a topological order goes: nodes on loops and behind them
        bad = order.join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        bad = links.join(bad.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        again = written(order.join(bad, "id", "left_semi"), "depth")
        if again.count() == order.count():
            break
        order = again
    links = links.join(order.withColumnRenamed("id", "src"), "src", "left_anti")
    if starts is None:
        starts = nodes.join(links.select(F.col("dst").alias("id")), "id", "left_anti")
    dist = front = written(starts.withColumn("depth", F.lit(0)), "depth")
    while front.limit(1).count():
        step = links.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("depth") + 1).cast("int").alias("depth"))
        front = written(step.join(dist.withColumnRenamed("depth", "old"), "id", "left").where("old IS NULL OR depth > old").select("id", "depth"), "depth")
        dist = written(dist.union(front).groupBy("id").agg(F.max("depth").alias("depth")), "depth")
    return dist


def longest(links: list[tuple], starts: set | None) -> dict:
    """Of nodes that starts lead to (those that nothing leads to, if None) the longest way's length."""
    out, waiting = defaultdict(list), defaultdict(int)
    nodes = {x for p in links for x in p}
    for a, b in links:
        out[a].append(b)
        waiting[b] += 1
    first = [n for n in nodes if not waiting[n]]
    dist = dict.fromkeys(first if starts is None else starts, 0)
    todo = deque(first)
    while todo:
        n = todo.popleft()
        for m in out[n]:
            if n in dist:
                dist[m] = max(dist.get(m, 0), dist[n] + 1)
            waiting[m] -= 1
            if not waiting[m]:
                todo.append(m)
    return dist


# --- reachability ----------------------------------------------------------------


def reach(links: DataFrame, sources: DataFrame, depth: int | None = None, through: DataFrame | None = None, small: int | None = None, most: int = MOST, ways: bool = True) -> DataFrame:
    """``(source, id, distance, via)`` along ``src -> dst`` from each ``source``; the source itself is not a result.

    ``via`` is the smallest node before ``id`` on a shortest way. ``through``
    holds the nodes that a way may go on from (sources always may). Groups that
    a task can hold are walked there, a source at a time; of others see
    :func:`_reach_by_joins`. Without ``ways`` there is no ``via``.
    """
    small, links = SMALL if small is None else small, links.select("src", "dst")
    shown = lambda found: found if ways else found.drop("via")
    rows = few(links, small)
    # as many sources as keep the walks to some tens of millions of steps at worst
    names = few(sources.select("id").distinct(), max(1000, WALKS // max(1, len(rows)))) if rows is not None else None
    kind = links.schema["src"].dataType.simpleString()
    if names is not None:
        out = defaultdict(list)
        for a, b in {(r.src, r.dst) for r in rows}:
            out[a].append(b)
        passing = None
        if through is not None and (ids := few(through.select("id"), small)) is not None:
            passing = {r.id for r in ids}
        if through is None or passing is not None:
            return shown(_frame(links.sparkSession, [x for s in names for x in _walk(out, s.id, depth, passing)], f"source {kind}, id {kind}, distance int, via {kind}"))
    own, large = parted(links, most)
    free = through is None  # tables stay on the driver
    flag = lambda df, name: df.select(F.col("id").alias("src"), F.lit(1).alias(name)).distinct()
    own = own.join(flag(sources, "asked"), "src", "left")
    own = own.withColumn("goes", F.lit(1)) if through is None else own.join(flag(through, "goes"), "src", "left")

    def walks(src, dst, asked, goes):
        out = defaultdict(list)
        for a, b in set(zip(src, dst)):
            out[a].append(b)
        passing = None if free else {a for a, g in zip(src, goes) if g}
        for s in {a for a, k in zip(src, asked) if k}:
            yield from _walk(out, s, depth, passing)

    found = shown(by_part(own.select("src", "dst", "asked", "goes", "root"), walks, f"source {kind}, id {kind}, distance int, via {kind}"))
    return found if large is None else found.union(_reach_by_joins(written(large.distinct(), "links"), sources, depth, through, ways))


def _reach_by_joins(step: DataFrame, sources: DataFrame, depth: int | None, through: DataFrame | None, ways: bool = True) -> DataFrame:
    """:func:`reach` in groups that no task can hold: for a tenth of the nodes and more as sources :func:`_balls`, else round by round."""
    kind = step.schema["src"].dataType.simpleString()
    starts = step.select(F.col("src").alias("id")).distinct()
    sources = written(sources.select("id").distinct().join(starts, "id", "left_semi"), "sources").hint("merge")
    if (depth is None or depth > 4) and sources.count() * 10 >= starts.count() and (found := _balls(step, depth, through)) is not None:
        balls, numbered = found
        asked = numbered.join(sources, "id", "left_semi").select(F.col("n").alias("source"))
        balls = balls.join(asked, "source", "left_semi")
        for side in ("source", "id", "via") if ways else ("source", "id"):
            balls = balls.join(numbered.toDF("name", side), side).drop(side).withColumnRenamed("name", side)
        return balls.select("source", "id", "distance", "via") if ways else balls.select("source", "id", "distance")
    front = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance"), F.lit(None).cast(kind).alias("via"))
    seen, d = front, 0
    while (depth is None or d < depth) and front.limit(1).count():
        d += 1
        allowed = front if through is None or d == 1 else front.join(through.select("id"), "id", "left_semi")
        found = allowed.select("source", F.col("id").alias("src")).join(step, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        front = written(found.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("distance"), "via"), "reach")
        seen = seen.union(front)  # each round is written once
    return seen.where("distance > 0").select("source", "id", "distance", *(("via",) if ways else ()))


def _balls(step: DataFrame, depth: int | None = None, through: DataFrame | None = None, dense: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``(source, id, distance, via)`` for all nodes as sources, as :func:`reach` has them, but with numbers; and ``(id, n)``, their names.

    None where a round would meet ``REPEATS`` times what is known, or where a node has more than ``dense`` pairs on average.

    All ways of up to n steps give those of up to 2 n: a longer one goes through
    a node n steps away, which has its own. So there are as many rounds as the
    longest way has binary digits, and a round writes what is new only. Nodes
    are numbers meanwhile, in the order of their names.
    """
    names = step.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbered = written(names.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()), "numbers").hint("merge")
    at = lambda side: numbered.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"))
    links = step.join(at("src"), "src").join(at("dst"), "dst").where("src_n <> dst_n")
    allowed = None if through is None else written(through.select("id").distinct().join(numbered, "id").select(F.col("n").alias("id")), "through").hint("merge")
    nodes = numbered.count()
    new = written(links.select(F.col("src_n").alias("source"), F.col("dst_n").alias("id"), F.lit(1).alias("distance"), F.col("src_n").alias("via")).distinct(), "balls")
    balls, radius, total = new, 1, new.count()
    while depth is None or radius < depth:
        rim = balls.where(F.col("distance") == radius).select("source", F.col("id").alias("mid"))
        rim = rim if allowed is None else rim.join(allowed.withColumnRenamed("id", "mid"), "mid", "left_semi")
        far = balls.select(F.col("source").alias("mid"), "id", (F.col("distance") + radius).alias("distance"), "via")
        far = far if depth is None else far.where(F.col("distance") <= depth)
        n = lambda rows, name: rows.groupBy("mid").agg(F.count(F.lit(1)).alias(name))
        meeting = n(rim, "a").hint("merge").join(n(far, "b").hint("merge"), "mid").agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0
        if meeting > REPEATS * (total + nodes):
            return None
        met = rim.hint("merge").join(far.hint("merge"), "mid").where("source <> id").select("source", "id", "distance", "via")
        both = met.withColumn("old", F.lit(0)).union(balls.withColumn("old", F.lit(1)))
        best = both.groupBy("source", "id").agg(F.max("old").alias("old"), F.min(F.struct("distance", "via")).alias("x")).where("old = 0")
        new = written(best.select("source", "id", "x.distance", "x.via"), "balls")
        more = new.count()
        if not more:
            break
        balls, radius, total = balls.union(new), 2 * radius, total + more
        if dense is not None and total > dense * nodes:
            return None
    return balls, numbered


def _walk(out: dict, source, depth: int | None, through: set | None):
    seen, front, d = {source}, [source], 0
    while front and (depth is None or d < depth):
        d += 1
        found: dict = {}
        for n in front:
            if d == 1 or through is None or n in through:
                for m in out[n]:
                    if m not in seen:
                        found[m] = min(found.get(m, n), n)
        for m, via in found.items():
            yield source, m, d, via
        seen |= found.keys()
        front = list(found)


def importers(edges: DataFrame, targets: DataFrame, depth: int | None = None, ways: bool = True) -> DataFrame:
    """Who depends on the targets, over edges of every kind: ``(source, id, distance, via)``."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, depth, ways=ways)


def impact(edges: DataFrame, targets: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """The nearest way to each module from any target, in one or both directions."""
    parts = []
    if direction in ("dependents", "both"):
        parts.append(importers(edges, targets, depth).withColumn("direction", F.lit("dependents")))
    if direction in ("dependencies", "both"):
        parts.append(reach(edges, targets, depth).withColumn("direction", F.lit("dependencies")))
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return both.join(targets.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("distance").alias("distance"))


def _ordered(src: list, dst: list) -> tuple[list[list], list[set]]:
    """The components of links, single nodes too, each behind all that lead to it; and what components lead to each."""
    comp = {m: g[0] for g in tarjan(list(zip(src, dst))) for m in g}
    of = lambda x: comp.get(x, x)
    into, out = defaultdict(set), defaultdict(set)
    held = defaultdict(list)
    for x in {*src, *dst}:
        held[of(x)].append(x)
    for a, b in zip(src, dst):
        if of(a) != of(b):
            into[of(b)].add(of(a))
            out[of(a)].add(of(b))
    left = {c: len(into[c]) for c in held}
    order = [c for c, n in left.items() if not n]
    for c in order:
        for d in out[c]:
            left[d] -= 1
            if not left[d]:
                order.append(d)
    at = {c: k for k, c in enumerate(order)}
    return [held[c] for c in order], [{at[x] for x in into[c]} for c in order]


def _counts(src: list, dst: list, bits: int = 8192):
    """``(id, n)`` of :func:`reach_counts` in one group or some: bits of so many sources at a time go once along the order."""
    groups, into = _ordered(src, dst)
    n, ends = [0] * len(groups), []
    for g in groups:
        ends.append((ends[-1] if ends else 0) + len(g))
    first = 0  # nothing before the block's first component has any of its bits
    while first < len(groups):
        base = ends[first] - len(groups[first])
        last = first
        while last + 1 < len(groups) and ends[last + 1] - base <= bits:
            last += 1
        seen: dict[int, int] = {}
        for k in range(first, len(groups)):
            w = 0
            for j in into[k]:
                w |= seen.get(j, 0)
            if k <= last:
                w |= ((1 << len(groups[k])) - 1) << (ends[k] - len(groups[k]) - base)
            if w:
                seen[k] = w
                n[k] += w.bit_count()
        first = last + 1
    for g, total in zip(groups, n):
        if total > 1:  # a node's own bit is no result
            for x in g:
                yield x, total - 1


def reach_counts(links: DataFrame, words: int = 16, most: int = MOST) -> DataFrame:
    """``(id, n)``: how many other nodes lead to a node along ``src -> dst``; nodes that none leads to are left out.

    Groups that a task can hold are counted there; see :func:`_counts_by_joins` for others.
    """
    kind = links.schema["src"].dataType.simpleString()
    own, large = parted(links.where("src <> dst").select("src", "dst"), most)
    found = by_part(own, _counts, f"id {kind}, n long")
    return written(found if large is None else found.union(_counts_by_joins(large, words)), "counts")


def _counts_by_joins(links: DataFrame, words: int) -> DataFrame:
    """:func:`reach_counts` in groups that no task can hold: pairs are counted where nodes have few, see :func:`_balls`.

    Else sources are bits, ``64 * words`` of them a row, so a round moves a row for
    each node and block of sources that reached it, not one for each pair, and
    what it adds is one ``OR`` in the shuffle. Rounds follow the longest of the
    shortest ways; each is written.
    """
    bits, names = 64 * words, [f"w{k}" for k in range(words)]
    step = written(links.where("src <> dst").select("src", "dst").distinct(), "steps")
    if (pairs := _balls(step, dense=DENSE)) is not None:
        balls, numbered = pairs
        return balls.groupBy(F.col("id").alias("n")).agg(F.count(F.lit(1)).alias("found")).join(numbered, "n").select("id", F.col("found").alias("n"))
    sources = step.select(F.col("src").alias("id")).distinct().withColumn("at", F.monotonically_increasing_id())
    sources = written(sources, "sources")  # numbers are what they are now
    block, bit = F.expr(f"at DIV {bits}"), F.expr(f"CAST(at % {bits} AS INT)")
    own = sources.withColumns({"block": block, "bit": bit}).select("id", "block", *(F.expr(f"CASE WHEN bit DIV 64 = {k} THEN shiftleft(1L, bit % 64) ELSE 0L END").alias(w) for k, w in enumerate(names)))
    either = [F.bit_or(w).alias(w) for w in names]
    state = front = written(own, "bits")
    while not front.isEmpty():
        met = step.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "block").agg(*either)
        old = state.select("id", "block", *(F.col(w).alias(f"o{w}") for w in names))
        new = met.join(old, ["id", "block"], "left").select("id", "block", *(F.expr(f"{w} & ~COALESCE(o{w}, 0L)").alias(w) for w in names))
        front = written(new.where(" OR ".join(f"{w} <> 0" for w in names)), "bits")
        state = written(state.union(front).groupBy("id", "block").agg(*either), "bits")
    found = state.groupBy("id").agg(F.sum(F.expr(" + ".join(f"bit_count({w})" for w in names))).alias("n"))
    known = found.join(sources.select("id", F.lit(1).alias("self")), "id", "left")
    return known.select("id", (F.col("n") - F.coalesce("self", F.lit(0))).cast("long").alias("n")).where("n > 0")


def runtime_leaks(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, direct``: client modules that import server-only ones, at once or through shared modules."""
    at = lambda side: modules.select(F.col("id").alias(side), F.col("runtime").alias(f"{side}_runtime"), F.col("is_server_actions").alias(f"{side}_actions"))
    modules = modules.hint("merge")
    typed = written(live(edges).select("src", "dst").join(at("src"), "src").join(at("dst"), "dst"), "typed").hint("merge")
    direct = typed.where("src_runtime = 'client' AND dst_runtime = 'server' AND NOT dst_actions").select("src", "dst").distinct()
    shared = modules.where("runtime = 'shared'").select("id")
    clients = typed.where("src_runtime = 'client' AND dst_runtime = 'shared'").select(F.col("src").alias("id")).distinct()
    links = typed.where("dst_runtime = 'shared'").select("src", "dst")
    ways = reach(links, written(clients, "clients").hint("merge"), through=shared).join(shared, "id", "left_semi").select(F.col("source").alias("client"), F.col("id").alias("src"))
    behind = ways.join(typed.where("dst_runtime = 'server' AND NOT dst_actions").select("src", "dst").distinct(), "src").select(F.col("client").alias("src"), "dst").distinct()
    return direct.withColumn("direct", F.lit(True)).union(behind.join(direct, ["src", "dst"], "left_anti").withColumn("direct", F.lit(False)))


def weak_components(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """``(id, root)`` of all nodes: the smallest one in the weakly connected component."""
    links = live(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    rows = few(links, SMALL if small is None else small)
    if rows is not None:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y] if y in up else y
                x = up[x]
            return x

        for r in rows:
            a, b = sorted((top(r.a), top(r.b)))
            up[b] = a
        kind = links.schema["a"].dataType.simpleString()
        found = _frame(edges.sparkSession, [(x, top(x)) for x in list(up)], f"id {kind}, root {kind}")
    else:
        found = roots(links.toDF("src", "dst"))
    return nodes.select("id").hint("merge").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def isolated(modules: DataFrame, edges: DataFrame, entries: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Components apart from the rest: ``root, n`` where no infrastructure, no entry and at most half of all modules."""
    total = modules.agg(F.count(F.lit(1)).alias("total"))
    named = weak_components(modules, edges).join(modules.select("id", "is_infra"), "id")
    if entries is not None:
        named = named.join(entries.select("id", F.lit(True).alias("entry")), "id", "left")
    else:
        named = named.withColumn("entry", F.lit(None).cast("boolean"))
    groups = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("is_infra", F.lit(False)) | F.coalesce("entry", F.lit(False))).alias("barred"))
    return groups.crossJoin(F.broadcast(total)).where(f"n >= {least} AND NOT barred AND n <= 0.5 * total").select("root", "n")  # total is one row


def folder_tree(modules: DataFrame) -> DataFrame:
    """Every folder with what lies below it: ``folder, depth, n_files, loc``; one row per ancestor before aggregation."""
    parts = F.split("id", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = modules.select("loc", F.posexplode(up).alias("depth", "folder"))
    return rows.groupBy("folder", "depth").agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc")).select("folder", F.col("depth").cast("long").alias("depth"), "n_files", "loc")
