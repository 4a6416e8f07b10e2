import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from arcspan.llm import suffixes


def brute(texts, width=200):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(1, 8))) for _ in range(n))
    passages = [prose(60) for _ in range(6)]
    out = []
    for _ in range(120):
        x = prose(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            a, k = r.randint(0, 80), r.randint(0, len(x))
            x = x[:k] + r.choice(passages)[a : a + r.randint(100, 400)] + x[k:]
        out.append(x + ("\nThis work is licensed under the GNU General Public License, version 3." if r.random() < 0.4 else ""))
    for _ in range(15):
        t = r.choice(out)
        k = r.randint(0, len(t))
        out.append(t[:k] + "é" + t[k:])
    return out + [out[3]] * 5 + ["", None, "a" * 199, "a" * 200, "a" * 201, "b" * 1000, "ab" * 700, ("-" * 250 + "x") * 3, "\0" * 300, "c" * 450]


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    for trial in range(120):
        t = bytes(r.choice(b"ab" if trial % 2 else b"abcd\0") for _ in range(r.randint(1, 300)))
        if trial % 5 == 0:
            t = t[:50] + b"a" * 30 + t[:70] + t[:50]
        data = np.frombuffer(t, dtype=np.uint8)
        order = suffixes.suffix_array(data, len(t) + 8)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffixes.common_prefixes(data, order, 400)
        for i in range(1, len(order)):
            a, b = t[order[i - 1] :], t[order[i] :]
            k = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), None)
            assert k is None or lcp[i] == k


def test_runs_cover_each_window_once():
    data = [(t or "").encode() for t in texts()]
    text, start, n, *_ = suffixes.runs_of(data)
    windows = Counter((t, i) for t, a, m in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(a, a + m))
    assert windows == Counter((k, i) for k, t in enumerate(data) for i in range(len(t) - 199))


@pytest.mark.parametrize("hot", [None, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:  # marks with more contents take another way
        monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [(k if k % 37 else None, t) for k, t in enumerate(texts())]
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter((k, *b) for (k, _), b in zip(rows, brute([(t or "").encode() for _, t in rows])))


def test_odd_rows(odd, empty, odd_rows):
    got = Counter(map(tuple, suffixes.without_repeats(odd).collect()))
    assert got == Counter((r[0], *b) for r, b in zip(odd_rows, brute([(r[1] or "").encode() for r in odd_rows])))
    assert suffixes.without_repeats(empty).collect() == []


def test_many_contents_that_repeat_only_themselves(spark, monkeypatch):
    """Each text is one period of its own: groups of one content fill sorts too, several of them."""
    rows = [(k, f"{k:03}-{chr(97 + k % 26)}" * 120) for k in range(400)]
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    want = brute([t.encode() for _, t in rows])
    assert Counter(map(tuple, got)) == Counter((k, *b) for (k, _), b in zip(rows, want)) and all(b[1] == b[0] for b in want)
