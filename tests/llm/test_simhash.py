import random
import re

import numpy as np
import xxhash

from arcspan.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, distance=2):
    """``(id, fp)`` to the smallest id reachable."""
    up = list(range(len(pairs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    low = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return [low.get(top(i)) for i in range(len(pairs))]


def test_odd_rows(odd, empty, odd_rows):
    prints = [(r[0], brute_print(r[1])) for r in odd_rows]
    want = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(prints, brute_components(prints))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str) == want
    assert simhash.near_duplicates(empty).collect() == []


def test_links_reach_all_that_is_near(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:  # chains, and a group that is far larger than a few
        x = b
        for _ in range(r.randint(0, 12)):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {base[0] ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    fps = sorted(fps)
    signed = [int(np.array([f], dtype=np.uint64).view(np.int64)[0]) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert len(links) < 28 * len(fps)
    place = {s: f for s, f in zip(signed, fps)}
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for link in links:
        a, b = place[link.a], place[link.b]
        up[max(top(a), top(b))] = min(top(a), top(b))
    want = brute_components([(k, f) for k, f in enumerate(fps)])
    got = [top(f) for f in fps]
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_large_lists_equal_small_ones():
    r = np.random.default_rng(6)
    members = np.unique(r.integers(0, 1 << 16, 300, dtype=np.uint64))
    shift = np.array([0, 8], dtype=np.uint64)
    a, b = simhash.list_links(members, shift, 2)
    want = brute_components([(int(m), int(m)) for m in members])
    root = {int(m): int(m) for m in members} | {int(x): int(y) for x, y in zip(a, b)}
    assert [root[int(m)] for m in members] == want
