import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from conftest import prose
from arcspan.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(n=80, seed=5):
    """Texts and copies with some words changed; similarities from 0.6 to 1."""
    r = random.Random(seed)
    texts = []
    for k in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((40, 100, 300, 1000)))]
        texts.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, int(len(copy) * r.choice((0.005, 0.01, 0.015, 0.02, 0.04))))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts


def roots(texts):
    sets = [brute_shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(texts))]


def test_similar_is_exact():
    for a, b in combinations(planted(8), 2):
        want = similarity(brute_shingles(a), brute_shingles(b)) >= 0.8
        assert nearcopies.similar(nearcopies.shingles(a.encode()), nearcopies.shingles(b.encode())) == want


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    texts = [*planted(), None, "", " \n", "one two", "One  two", "one three"]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    left = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert left == sorted(set(roots(texts)))


def test_a_large_group_costs_one_candidate_a_band(spark):
    r = random.Random(1)
    words = prose(200, 3).split()
    texts = []
    for k in range(120):
        copy = list(words)
        copy[r.randrange(200)] = f"x{k}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({x.root for x in nearcopies.classes(docs).collect()}) == len(set(roots(texts))) == 1
    assert nearcopies.links(docs).count() <= 120 * nearcopies.BANDS


def test_texts_unlike_their_leader_meet_each_other(spark, monkeypatch):
    # one band of one minimum: buckets are large and hold many groups that only later rounds join
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    shared = prose(60, 77)
    texts = [f"{shared} {prose(90, 100 + k % 9)} {'x' if k > 26 else ''} tail{k}" for k in range(36)]
    real = nearcopies.bands
    monkeypatch.setattr(nearcopies, "bands", lambda found: np.where(np.arange(nearcopies.BANDS) < 2, 5, real(found)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "by_batch", _in_driver)
    got = {x.doc_id: x.root for x in nearcopies.classes(docs).collect()}
    want = roots(texts)
    assert [min(k for k in got if got[k] == got[j]) for j in range(36)] == want and len(set(want)) == 9


def _in_driver(df, f, schema):
    import pyarrow as pa

    rows = [r for b in pa.Table.from_pandas(df.toPandas(), preserve_index=False).to_batches() for out in [f(b)] for r in zip(*(v.to_pylist() if hasattr(v, "to_pylist") else v for v in out.values()))]
    return df.sparkSession.createDataFrame(rows, schema)


def test_rows_that_share_a_key_or_have_none_are_told_apart_by_their_texts(spark):
    a, b, c, d = (prose(60, k) for k in (21, 22, 23, 24))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (8, c), (None, d)]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in rows], SCHEMA)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)
    assert left[0].__fields__ == docs.columns


def templated(pairs, own, both, n, seed=9):
    """Pairs of texts in one template: each text changes ``own`` of its words, and ``both`` more just as its partner does."""
    r, texts = random.Random(seed), []
    for k in range(pairs):
        at = r.sample(range(4, n - 5, 6), 2 * own + both)  # apart, so each changes five shingles
        one, two = ([f"t{j}" for j in range(n)] for _ in range(2))
        for j in at[:both]:
            one[j] = two[j] = f"p{k}x{j}"
        for j, side in zip(at[both:], [one, two] * own):
            side[j] = f"q{k}x{j}"
        texts += [" ".join(one), " ".join(two)]
    return texts


def test_pairs_in_a_template(spark):
    """Each pair is similar to 0.8 or a little more, pairs among each other are not: 0.99 of them are found, none is merged."""
    for own, both, n, within, across in ((5, 1, 455, 0.8004, 0.765), (5, 1, 500, 0.817, 0.784), (4, 2, 500, 0.851, 0.784)):
        texts = templated(150, own, both, n)
        sets = [brute_shingles(t) for t in texts]
        assert abs(similarity(sets[0], sets[1]) - within) < 0.001 and abs(similarity(sets[0], sets[2]) - across) < 0.01
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        root = {x.doc_id: x.root for x in nearcopies.classes(docs).collect()}
        assert sum(root[k] == root[k + 1] for k in range(0, 300, 2)) >= 149
        want = roots(texts)  # pairs may be alike by chance too
        assert all(want[j] == want[k] for j, k in combinations(range(300), 2) if root[j] == root[k])
        linked = [(j, k) for j, k in combinations(range(300), 2) if want[j] == want[k] and similarity(sets[j], sets[k]) >= 0.8]
        assert sum(root[j] == root[k] for j, k in linked) >= 0.99 * len(linked)


def test_index_of_fingerprints_gives_candidates_of_its_own(spark, monkeypatch):
    """Without any pair from MinHash, texts whose fingerprints are equal or near are linked all the same, and others are not."""
    whole = nearcopies._round
    monkeypatch.setattr(nearcopies, "_round", lambda open_, turn: (whole(open_, turn)[0].limit(0), whole(open_, turn)[1].limit(0)))
    text = prose(2000, 3)
    rows = [(1, text), (2, text.replace(" ", "\n")), (3, text + " end"), (4, prose(2000, 4)), (5, None), (6, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    # the third differs from the first in one shingle of 1,997, by which no bit's majority turns
    assert nearcopies.similar(nearcopies.shingles(rows[0][1].encode()), nearcopies.shingles(rows[2][1].encode()))
    found = {r.doc_id: r.root for r in nearcopies.classes(docs).collect()}
    assert found[1] == found[2] == found[3] and found[5] == found[6] and len({found[1], found[4], found[5]}) == 3


def test_no_list_is_given_up(spark, monkeypatch):
    """Links between texts that have leaders of their own, which are unlike, are found in large lists all the same (F9)."""
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    real = nearcopies.bands
    monkeypatch.setattr(nearcopies, "bands", lambda found: np.where(np.arange(nearcopies.BANDS) < 24, 5, real(found)))  # one bucket has all texts
    monkeypatch.setattr(nearcopies, "index_pairs", lambda prints: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(nearcopies, "DEAL", 3)
    # ten chains, in which each text changes one word more than the one before: neighbours are similar, the ends are not
    texts = [" ".join(f"x{c}y{j}" if j < 5 * k else f"c{c}w{j}" for j in range(90)) for c in range(10) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "by_batch", _in_driver)
    got = {x.doc_id: x.root for x in nearcopies.classes(docs).collect()}
    want = roots(texts)
    assert len(set(want)) == 10 and [min(k for k in got if got[k] == got[j]) for j in range(40)] == want
