"""Inside a cycle: feedback edges, what they break, patterns and the edge to cut.

These are sequential in a component, so components are dealt to tasks whole. Work beyond the limits is
cut off and marked ``partial``, as the operator defines.
"""

from __future__ import annotations

import heapq
import posixpath
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import live
from .parts import ROWS

EXACT, PATHS, CYCLES, STEPS = 20, 200, 100_000, 200_000
_INDEX = re.compile(r"^index\.(ts|tsx|js|jsx|mjs|cjs|vue|svelte)$")


def vertex_order(pairs: set[tuple[str, str]], members: list[str]) -> list[str]:
    """Sinks go last, sources first; where there are neither, the vertex with most edges out over in (the smallest name of those) goes next.

    Sinks and sources are taken in sweeps over the members; a vertex that
    becomes one behind the sweep's place waits for the next. Each edge is taken
    away once, and degrees are kept in a heap, so the work is that of the edges
    times the logarithm of their number.
    """
    out: dict[str, set[str]] = {m: set() for m in members}
    into: dict[str, set[str]] = {m: set() for m in members}
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            into[b].add(a)
    place = {m: k for k, m in enumerate(members)}
    left, head, tail = set(members), [], []
    degrees = [(len(into[v]) - len(out[v]), v) for v in members]
    heapq.heapify(degrees)
    # of sinks and of sources: those of this sweep, by place, and those that wait
    now: list[list[int]] = [[], []]
    later: list[list[int]] = [[k for k, v in enumerate(members) if not edges[v]] for edges in (out, into)]
    at = [-1, -1]

    def opened(kind: int, v: str) -> None:
        if place[v] > at[kind]:
            heapq.heappush(now[kind], place[v])
        else:
            later[kind].append(place[v])

    def take(v: str) -> None:
        left.discard(v)
        for w in out.pop(v):
            into[w].discard(v)
            heapq.heappush(degrees, (len(into[w]) - len(out[w]), w))
            if not into[w]:
                opened(1, w)
        for w in into.pop(v):
            out[w].discard(v)
            heapq.heappush(degrees, (len(into[w]) - len(out[w]), w))
            if not out[w]:
                opened(0, w)

    def swept(kind: int, taken: list[str]) -> bool:
        now[kind], later[kind], moved = sorted({*now[kind], *later[kind]}), [], False
        at[kind] = -1
        while now[kind]:
            k = heapq.heappop(now[kind])
            if (v := members[k]) in left:
                at[kind] = k
                taken.append(v)
                take(v)
                moved = True
        at[kind] = len(members)  # what opens now waits for the next sweep
        return moved

    at = [len(members)] * 2
    while left:
        while swept(0, tail) | swept(1, head):
            pass
        while left:
            degree, v = heapq.heappop(degrees)
            if v in left and degree == len(into[v]) - len(out[v]):
                head.append(v)
                take(v)
                break
    return head + tail[::-1]


def feedback(pairs: set[tuple[str, str]], members: list[str]) -> set[tuple[str, str]]:
    """Edges without which no cycle is left; loops always are."""
    at = {m: k for k, m in enumerate(vertex_order(pairs, members))}
    return {(a, b) for a, b in pairs if a == b or at[a] > at[b]}


def elementary(pairs: set[tuple[str, str]], members: list[str], limit: int = CYCLES) -> tuple[list[list[str]], bool]:
    """All elementary cycles, each from its smallest member, and whether the limit cut them off."""
    out = {m: sorted(b for a, b in pairs if a == m) for m in members}
    found: list[list[str]] = []
    for start in sorted(members):
        blocked, waiting = {start}, {m: set() for m in members}
        path, todo, closed = [start], [[n for n in out[start] if n >= start]], set()
        while todo:
            if todo[-1]:
                n = todo[-1].pop(0)
                if n == start:
                    if len(found) >= limit:
                        return found, True
                    found.append(list(path))
                    closed.update(path)
                elif n not in blocked:
                    path.append(n)
                    todo.append([m for m in out[n] if m >= start])
                    closed.discard(n)
                    blocked.add(n)
                continue
            v = path[-1]
            if v in closed:
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free += waiting[u]
                        waiting[u].clear()
            else:
                for m in out[v]:
                    if m >= start:
                        waiting[m].add(v)
            todo.pop()
            path.pop()
            if path and v in closed:
                closed.add(path[-1])
    return found, False


def followers(pairs: set[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    return out


def simple_paths(out: dict[str, list[str]], source: str, target: str, paths: int = PATHS, steps: int = STEPS) -> tuple[int, bool]:
    """How many simple paths lead from source to target, up to the limits."""
    if source == target:
        return 1, False
    count, done, on, todo = 0, 1, {source}, [(source, iter(out.get(source, ())))]
    while todo:
        v, rest = todo[-1]
        for w in rest:
            if count >= paths or done >= steps:
                return count, True
            if w in on:
                continue
            done += 1
            if w == target:
                count += 1
            else:
                on.add(w)
                todo.append((w, iter(out.get(w, ()))))
                break
        else:
            on.discard(v)
            todo.pop()
    return count, False


def broken(pairs: set[tuple[str, str]], members: list[str], back: set[tuple[str, str]]) -> tuple[dict[tuple[str, str], tuple[int, bool]], int]:
    """Of each feedback edge how many cycles go through it; and the number of all cycles, -1 if not counted."""
    if len(members) > EXACT:
        out = followers(pairs)
        return {(a, b): simple_paths(out, b, a) for a, b in back}, -1
    found, cut = elementary(pairs, members)
    counts = dict.fromkeys(back, 0)
    for c in found:
        for e in zip(c, [*c[1:], c[0]]):
            if e in counts:
                counts[e] += 1
    return {e: (n, cut) for e, n in counts.items()}, -1 if cut else len(found)


def pattern(pairs: set[tuple[str, str]], members: list[str], back: set[tuple[str, str]]) -> str:
    if len(members) == 2 and {tuple(members), tuple(reversed(members))} <= pairs:
        return "mutual-pair"
    if len(back) <= 2:
        indexes = [m for m in members if _INDEX.match(posixpath.basename(m))]
        if len(indexes) == 1 and any(m != indexes[0] and posixpath.dirname(m) == posixpath.dirname(indexes[0]) for m in members):
            return "barrel-cycle"
    if len(back) >= 2:
        if max(Counter(b for _, b in back).values()) / len(back) >= 0.7:
            return "hub-feedback"
    return "long-chain" if len(members) > 8 and 0 < len(back) <= 2 else "mixed"


def ring(pairs: set[tuple[str, str]], members: list[str]) -> tuple[str, str] | None:
    """If the edges are one ring through all members (sorted) and no more, the one that closes it: it leads to the smallest name, where the order begins."""
    out = dict(pairs)
    if not 1 < len(members) == len(pairs) == len(out):
        return None
    last, n = members[0], 1
    while (after := out.get(last)) != members[0]:
        if after is None or n == len(members):
            return None
        last, n = after, n + 1
    return (last, members[0]) if n == len(members) else None


def _reading(comp, pairs: set[tuple[str, str]]) -> list[tuple]:
    """The rows of :func:`explained` of one component."""
    names = sorted({x for p in pairs for x in p})
    closing = ring(pairs, names) if len(names) < STEPS // 2 else None
    if closing:
        back = {closing}
        counts, total = {closing: (1, False)}, 1 if len(names) <= EXACT else -1
    else:
        back = feedback(pairs, names)
        counts, total = broken(pairs, names, back)
    label = pattern(pairs, names, back)
    able = [e for e in back if e[0] != e[1] or len(names) == 1]
    cut = min(able, key=lambda e: (-counts[e][0], e), default=None)
    return [(comp, a, b, *counts[a, b], total, label, (a, b) == cut) for a, b in sorted(back)]


def explained(edges: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each feedback edge: ``comp, src, dst, broken, partial, total_cycles, pattern, breakpoint``.

    ``breakpoint`` marks the edge that breaks most cycles (the smallest name
    of those, and no loop in a component of several). A task reads its
    components one after the other, as most are too small for a call of their own.
    """
    at = lambda side: members.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    kind = members.schema["id"].dataType.simpleString()
    inner = live(edges).select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").where("src_comp = dst_comp").select(F.col("src_comp").alias("comp"), "src", "dst")
    schema = f"comp {kind}, src {kind}, dst {kind}, broken long, partial boolean, total_cycles long, pattern string, breakpoint boolean"
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        comp, pairs, types = None, set(), None

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=columns)
            rows.clear()
            return out

        for b in batches:
            types = [*b.schema.types, pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
            for c, src, dst in zip(*(x.to_pylist() for x in b.columns)):
                if c != comp:
                    if pairs:
                        rows += _reading(comp, pairs)
                    comp, pairs = c, set()
                pairs.add((src, dst))
            if len(rows) >= ROWS:
                yield batch()
        if pairs:
            rows += _reading(comp, pairs)
        if rows:
            yield batch()

    return inner.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, schema)
