import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from arcspan.llm import mixing, queries

TREE = ["domain", "lang", "source"]


def waterfill(budget, children):
    """``{name: (weight, cap)}``: what is given round by round, the plain way, as exact fractions."""
    given, open_ = dict.fromkeys(children, Fraction(0)), {n for n, (w, c) in children.items() if w and c}
    left = Fraction(budget)
    while left and open_:
        share = left / sum(children[n][0] for n in open_)
        full = {n for n in open_ if children[n][1] - given[n] <= share * children[n][0]}
        if not full:
            for n in open_:
                given[n] += share * children[n][0]
            return given
        for n in full:
            left -= children[n][1] - given[n]
            given[n] = Fraction(children[n][1])
        open_ -= full
        # others keep their claim on what is left
    return given


def test_budgets_follow_weights_and_caps(spark):
    r = random.Random(2)
    leaves = [(d, lang, s, r.randint(1, 900)) for d in "ab" for lang in "xyz" for s in map(str, range(r.randint(1, 5)))]
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"x": 5, "z": 0}, "source": {"0": 4}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for share in (Fraction(1, 10), Fraction(1, 2), Fraction(9, 10), Fraction(5)):
        total = int(sum(x[3] for x in leaves) * share)
        rows = mixing.budgets(df, TREE, weights, F.lit(total), 2).collect()
        got = {(x.domain, x.lang, x.source): x.alloc for x in rows}
        cap = {x[:3]: 0 if x[1] == "z" else 2 * x[3] for x in leaves}
        below = lambda *at: sum(c for k, c in cap.items() if k[: len(at)] == at)  # noqa: E731, B023
        assert sum(got.values()) == min(total, sum(cap.values()))
        top = waterfill(min(total, sum(cap.values())), {d: (weights["domain"][d], below(d)) for d in "ab"})
        for d in "ab":
            in_d = waterfill(top[d], {x: (weights["lang"].get(x, 1), below(d, x)) for x in "xyz"})
            for x in "xyz":
                names = [k[2] for k in cap if k[:2] == (d, x)]
                leaf = waterfill(in_d[x], {s: (weights["source"].get(s, 1), cap[d, x, s]) for s in names})
                for s in names:
                    assert abs(got[d, x, s] - leaf[s]) < 4  # whole tokens at three levels
        assert all(got[k] <= cap[k] for k in got)


def brute_taken(rows, ends, seed):
    out = []
    for e in ends:
        leaf = [r for r in rows if r[1:4] == (e.domain, e.lang, e.source) and r[4]]
        for p in range(e.passes):
            out += [(r[0], p, r[4]) for r in leaf]
        left = e.rest
        for r in sorted(leaf, key=lambda r: hashlib.md5(f"{seed}|{e.passes}|{'' if r[0] is None else r[0]}|{r[4]}".encode()).hexdigest()):  # noqa: B023
            if left:
                out.append((r[0], e.passes, min(r[4], left)))
                left -= min(r[4], left)
        assert not left
    return sorted(out, key=str)


def test_prefixes_against_brute_force(spark):
    r = random.Random(8)
    rows = [(k, r.choice("ab"), r.choice("xy"), r.choice("st"), r.randint(0, 40)) for k in range(400)] + [(7, "a", "x", "s", 5), (7, "a", "x", "s", 5), (None, "a", "x", "s", 9)]
    rows += [(None, "b", "x", "t", r.choice((3, 30))) for _ in range(300)] + [(12, "b", "x", "s", 50)] * 60
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long").repartition(5)
    for share in ((3, 10), (19, 10)):
        ends = mixing.prefixes(df, TREE, {"domain": {"a": 1, "b": 6}}, share, 4, "s")
        got = mixing.taken(df, ends, TREE, "s").collect()
        assert sorted(((x.doc_id, x.epoch, x.taken) for x in got), key=str) == brute_taken(rows, ends.collect(), "s")


def test_budgets_are_met_to_the_token_however_keys_repeat(spark):
    for keys in ([None] * 60, [k % 3 for k in range(60)], [None if k % 2 else k for k in range(60)]):
        df = spark.createDataFrame([(k, "a", "x", "s", 100) for k in keys], "doc_id long, domain string, lang string, source string, n_tokens long").repartition(4)
        for tokens in (950, 7350):
            ends = mixing.prefixes(df, TREE, {}, (tokens, 6000), 3, "s")
            assert sum(r.taken for r in mixing.taken(df, ends, TREE, "s").collect()) == tokens


def test_odd_rows(spark, odd, empty):
    docs = queries.with_tree(odd)
    ends = mixing.prefixes(docs, queries.TREE, queries.WEIGHTS, (1, 1), 3, "s")
    rows = mixing.taken(docs, ends, queries.TREE, "s")
    assert {"score", "n_words"} <= set(rows.columns)
    got = rows.collect()
    assert all(0 < r.taken <= r.n_tokens for r in got) and not {3, 4, 5} & {r.doc_id for r in got}
    docs = queries.with_tree(empty)
    assert mixing.taken(docs, mixing.prefixes(docs, queries.TREE, {}, (1, 1), 3, "s"), queries.TREE, "s").collect() == []
