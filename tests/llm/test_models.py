"""Toxicity and quality: accuracy on rows whose labels were not used."""

import zlib
from functools import cache

import numpy as np
import pytest

from arcspan.llm import quality, queries, toxicity


def test_held_out_rows(spark, sf):
    for f, folds, fold in ((queries.op4_toxicity, 3, 1), (queries.op10_quality, 4, 2)):
        rows = f(spark, sf).collect()
        assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("table", ["sf0.1"])
def test_toxicity_accuracy(spark, table):
    d = f"/root/testdata/{table}"
    rows = queries.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.03


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(toxicity.judged(docs, labels)) == key(toxicity.judged(docs, turned))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (7, 1, 0), (9, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (toxicity, quality):
        for given in (labels, none):
            rows = module.judged(odd, given).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert module.judged(empty, labels).collect() == []
    assert {r.score for r in toxicity.judged(odd, none).collect()} == {0.5}


def test_probabilities_sum_to_one():
    from collections import Counter

    pairs = np.random.default_rng(1).integers(0, 5, (256, 256)).astype(float)
    low = toxicity.shared_table(pairs)
    assert abs(sum(low[bytes([65, b])] for b in range(256)) - 1) < 1e-6
    model = toxicity.KneserNey(Counter({b"idiot": 3, b"idea": 1, b"the": 9}), low)
    for h in (b" i", b" id", b"idi", b"idio", b" zz"):
        assert abs(sum(model.p(h + bytes([b])) for b in range(256)) - 1) < 1e-6


def brute_p(words, shared, gram):
    """The probability of a gram's last byte after the others, straight from the definition; the two lowest orders are shared."""
    places = [(t[max(0, i - 4) : i + 1], n) for w, n in words.items() for t in [b" " + w + b" "] for i in range(2, len(t))]
    seen = sorted({b for w in words for b in w} | {32, *gram})  # no other byte has a count
    every = [bytes([b]) for b in seen]

    @cache
    def count(g):
        direct = sum(n for x, n in places if x == g)
        return direct + (sum(count(b + g) > 0 for b in every) if len(g) < 5 else 0)

    def p(g):
        if len(g) <= 2:
            return shared[g]
        after = [count(g[:-1] + b) for b in every]
        if not sum(after):
            return p(g[1:])
        taken = [(0, 0.95, 1.4, 1.7)[min(3, c)] for c in after]
        k = seen.index(g[-1])
        return (after[k] - taken[k]) / sum(after) + sum(taken) / sum(after) * p(g[1:])

    return p(gram)


def test_figures_against_brute_force():
    import random
    from collections import Counter

    r = random.Random(3)
    some = lambda n: Counter({"".join(r.choice("abc") for _ in range(r.randint(1, 6))).encode(): r.randint(1, 4) for _ in range(n)})
    plain, toxic = some(7), some(6)
    pairs = toxicity._pairs([*(plain + toxic), b"abcabc", b"zz"]).reshape(256, 256).astype(float)
    shared = toxicity.shared_table(pairs)
    table = toxicity.difference([plain, toxic], pairs)
    text = list(plain)[:2] + list(toxic)[:2] + [b"abcabc", b"zz"]
    want = []
    for w in text:
        t = b" " + w + b" "
        grams = [t[max(0, i - 4) : i + 1] for i in range(2, len(t))]
        want.append(sum(np.log(brute_p(toxic, shared, g) / brute_p(plain, shared, g)) for g in grams))
    assert np.allclose([toxicity.word_difference(w, table) for w in text], want)
    raw = b" ".join(text)
    assert np.isclose(toxicity.Scorer(table, None)(raw), np.mean(want))
    assert np.isclose(toxicity.Scorer(table, 0.5)(raw), np.mean([max(0, d - 0.5) for d in want]))


def test_shared_counts_are_of_distinct_words_of_the_whole_corpus(spark):
    texts = ["Bad bad word", "word", None, "", "é!é x" * 3, "ab " * 5000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = toxicity.pair_counts(toxicity.vocabulary(docs))
    words = {w for t in texts for w in toxicity.words_of((t or "").encode())}
    want = np.zeros((256, 256))
    for w in words:
        t = b" " + w + b" "
        for a, b in zip(t, t[1:]):
            want[a, b] += 1
    assert (got == want).all()


def test_conflicting_labels_and_repeated_keys_have_one_outcome(spark):
    texts = [(k, f"{'idiot scum' if k % 2 else 'kind words'} here {k}") for k in range(60)]
    docs = spark.createDataFrame(texts + [(3, "another text of three")] * 4, "doc_id long, text string")
    given = [(k, 1 - k % 2, k % 2) for k in range(60)]
    agreed = spark.createDataFrame([g for g in given if g[0] != 5], "doc_id long, quality int, toxic int")
    torn = spark.createDataFrame([*given, (5, 1, 0), (5, 1, 0), *given[:3]], "doc_id long, quality int, toxic int")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    for module in (toxicity, quality):
        assert key(module.judged(docs, agreed)) == key(module.judged(docs, torn)) == key(module.judged(docs.repartition(7), torn.repartition(3)))


def test_a_labelled_text_beyond_the_bound_changes_nothing_else(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    sizes = {r.y: r.n for r in toxicity.sampled(docs, labels, 3, 1, 2000, "text", "doc_id").selectExpr("y", "octet_length(t) AS n").groupBy("y").max("n").toDF("y", "n").collect()}
    bound = 4 * max(sizes.values())
    want = toxicity.train(docs, labels, most=bound)
    assert want.table
    for toxic in (0, 1):
        far = next(k for k in range(10**9, 10**9 + 99) if zlib.crc32(str(k).encode()) % 3 != 1)
        more = docs.union(spark.createDataFrame([(far, "vile words and more " * (bound // 18))], "doc_id long, text string"))
        got = toxicity.train(more, labels.union(spark.createDataFrame([(far, toxic)], labels.schema)), most=bound)
        assert got.table.keys() >= {k for k in want.table} and np.isclose(got.slope, want.slope, rtol=0.2)
        words = lambda m: {k: round(v, 3) for k, v in list(m.table.items())[:200]}
        assert sum(words(got).get(k) == v for k, v in words(want).items()) > 100


def test_long_texts_and_words_are_scored_whole(spark):
    table = {b"id": 4.0, b" i\0": 0.1}
    score = toxicity.Scorer(table, None)
    long = b"x" * 300_000
    assert score(long + b" id") == score(b"x id") and long not in score.memo


def test_trees_against_brute_force():
    r = np.random.default_rng(7)
    x = r.normal(size=(90, 3)).round(1)
    y = ((x[:, 0] + x[:, 1] > 0.2) ^ (r.random(90) < 0.1)).astype(float)
    model = quality.grow(x, y, 3, 2)
    known = y.mean()
    margin = np.full(90, np.log(known / (1 - known)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        nodes = [np.arange(90)]
        for _ in range(2):
            below = []
            for rows in nodes:
                weight = lambda rows: (p - y)[rows].sum() ** 2 / ((p * (1 - p))[rows].sum() + quality.RIDGE)  # noqa: B023, E731
                best, split = 1e-9, (rows, rows[:0])
                for j in range(3):
                    for c in cuts[j]:
                        left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        gain = weight(left) + weight(right) - weight(rows)
                        if min(len(left), len(right)) >= quality.LEAST and gain > best + 1e-9:
                            best, split = gain, (left, right)
                below += split
            nodes = below
        for rows in nodes:
            margin[rows] -= quality.RATE * (p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + quality.RIDGE)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-margin)))


def test_flat_trees_equal_walked_ones():
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.grow(x, y, 60, 3)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.9
    for row in x[:50]:
        total = model.start
        for f, c, v in zip(model.feature, model.cut, model.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            total += v[at - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - model.scores(row[None])[0]) < 1e-12
