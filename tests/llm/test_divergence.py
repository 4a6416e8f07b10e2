"""Divergences against brute force and against the SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from arcspan.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"


def expected(rows, min_docs=divergence.MIN_DOCS):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        df, total, own = Counter(), Counter(), {}
        for _, source, words in (x for x in docs if x[0] == lang):
            df.update(set(words))
            total.update(words)
            own.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= min_docs]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(own[s]) for s in own}, share(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= 10]
    return sorted(out)


def made(seed, n):
    """A hot source, sources with few terms, equal vectors, ties, nulls, a language without kept terms, repeated rows."""
    r, rows = random.Random(seed), []
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(60)]
    for i in range(n):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["hot", "hot", "hot", "b", "Ü", None, "zz"])
        own = words if source == "hot" else words[:25]
        rows.append((" ".join(r.choice(own).title() if i % 5 else r.choice(own) for _ in range(r.randrange(30))) + r.choice(["", "\0x1y", " -- 42", "\tWA'wb"]), lang, source))
    rows += [rows[0]] * 12
    rows += [("pair pair", "fr", "b"), (None, "fr", "c"), ("", "it", "only"), ("x" * 70000 + " " + "long " * 20000, "en", "b")]
    return rows


def found(spark, rows, **how):
    df = spark.createDataFrame([(1, *x, "clash", 0) for x in rows], SCHEMA)
    got = divergence.divergences(df, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("held", [divergence.HELD, 40])
def test_brute_force(spark, held):
    rows = made(3, 300)
    got = found(spark, rows, held=held)
    assert got == expected(rows)
    assert {x[2] for x in got} == {"pair", "term"} and any(x[4] == 0 for x in got if x[0] == "fr")


def test_terms_in_few_sources(spark):
    """Terms that no other source has: what a pair lacks counts by the source's share alone."""
    rows = [(f"only{s} {'shared ' * (i % 3)}" + " ".join(f"t{s}{chr(97 + k)}" for k in range(9)), "en", s) for s in "abcdefg" for i in range(12)]
    assert found(spark, rows) == expected(rows)


def test_empty(spark, empty):
    assert divergence.divergences(empty).collect() == []


def test_terms():
    assert divergence.terms("Ab@cD[É`z{é\x7f\x00Ω1".encode()) == [b"ab", b"cd", "É".encode(), b"z", "é".encode(), "Ω".encode()]


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE["op13_divergence"])
    columns = [c[0] for c in want.description]
    got = queries.op13_divergence(spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
