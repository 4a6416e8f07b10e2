"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled texts, give each word a
probability byte by byte: a byte is predicted from up to ``ORDER - 1`` bytes
before it in the word, a blank standing at either end. Both interpolate as
Kneser and Ney do, with a discount for grams seen once, twice and more often:
at the longest context a gram counts the texts that use its word, so one text
that repeats an expression weighs no more than another, and below it the
different bytes that stand before it. Contexts of one byte and none are
shared: their counts are taken over the vocabulary of the whole corpus, each
distinct word once (a continuation count), so what is rare in either class
falls back on the same distribution. The vocabulary is a table that grows with
the corpus; only counts by pairs of bytes come to the driver.

A word's figure is the difference of its two log-likelihoods, a text's the
mean over its words of what exceeds ``margin`` nats (``None``: of the plain
differences). Differences below that are the noise of a finite sample (of its
mix of languages, above all) and would drown the few words that make a long
text toxic; the README has the figures of both forms. A logistic curve fitted
on figures of held-back training texts maps it to a score. What a text needs
of the models is that difference for each seen context and byte, so one table
of bounded size is broadcast.

Bound: at most ``SAMPLE`` labelled texts of each class are fitted, those whose
key has the smallest hash, and of them, in that order, each that still fits
into ``SAMPLE_BYTES`` (a documented sample). Their words are counted on the executors. The
shared counts cover all texts.

Defined cases: a text without words (null, empty, blank) has figure 0; without
a labelled text of each class every score is 0.5; repeated rows get the same
score; a key whose labels contradict each other teaches nothing, and of
several texts of one labelled key the one with the smallest hash is learnt
from; a labelled text of over ``SAMPLE_BYTES`` is passed over and changes
nothing else; texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_batch, held, held_out, known_labels, trimmed, written

ORDER, SAMPLE, MARGIN = 5, 2000, 3.0
SAMPLE_BYTES = 1 << 25  # of each class
DISCOUNTS = (0.95, 1.4, 1.7)  # of grams seen once, twice, more often
DISCOUNT = 0.75  # of the shared counts
SHARED = 2  # orders whose counts all texts share
THRESHOLD = 0.7

# White space and ASCII punctuation end a word; letters are lower-cased.
_BREAKS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_BREAKS).split()


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct word of the corpus, once a batch before it is shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        found: set[bytes] = set()
        for raw in as_bytes(batch.column(0)):
            found.update(words_of(raw))
        return {"word": list(found)}

    return by_batch(docs.select(text), run, "word binary").distinct()


def pair_counts(words: DataFrame) -> np.ndarray:
    """In how many distinct words a byte follows another, 256 x 256, a blank at either end; at most 65,536 rows collected."""

    def run(batch: pa.RecordBatch) -> dict:
        total, waiting, size = np.zeros(65536, dtype=np.int64), [], 0
        for w in batch.column(0).to_pylist():
            waiting.append(w)
            if (size := size + len(w)) > 1 << 20:
                total += _pairs(waiting)
                waiting, size = [], 0
        total += _pairs(waiting)
        at = np.nonzero(total)[0]
        return {"pair": pa.array(at.astype(np.int32)), "n": pa.array(total[at])}

    table = np.zeros(65536)
    for r in by_batch(words.select("word"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair] = r.n
    return table.reshape(256, 256)


def _pairs(words: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int32)
    return np.bincount((x[:-1] << 8) + x[1:], minlength=65536) if words else 0


class KneserNey:
    """One class: interpolated probabilities of a byte after a context inside a word."""

    def __init__(self, words: Counter, shared: dict[bytes, float]):
        self.shared = shared
        counts: dict[int, Counter] = {n: Counter() for n in range(SHARED + 1, ORDER + 1)}
        for w, c in words.items():
            t = b" " + w + b" "
            for i in range(SHARED, len(t)):  # near the word's start, the longest context is a short one
                g = t[max(0, i + 1 - ORDER) : i + 1]
                counts[len(g)][g] += c
        for n in range(ORDER, SHARED + 1, -1):
            for g in counts[n]:
                counts[n - 1][g[1:]] += 1
        total: dict[bytes, float] = defaultdict(float)
        taken: dict[bytes, float] = defaultdict(float)
        self.left: dict[bytes, float] = {}
        for n in counts:
            for g, c in counts[n].items():
                d = DISCOUNTS[min(3, c) - 1]
                total[g[:-1]] += c
                taken[g[:-1]] += d
                self.left[g] = c - d
        self.total = dict(total)
        self.back = {h: taken[h] / total[h] for h in total}

    def p(self, gram: bytes) -> float:
        if len(gram) <= SHARED:
            return self.shared.get(gram) or self.shared[b""]
        h, below = gram[:-1], self.p(gram[1:])
        return self.left.get(gram, 0.0) / self.total[h] + self.back[h] * below if h in self.total else below


def shared_table(pairs: np.ndarray) -> dict[bytes, float]:
    """Shared probabilities of a byte after one byte, backing off to continuation counts, then to all 256 alike."""
    kinds = (pairs > 0).sum(axis=0)
    low = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * (kinds > 0).sum() / 256) / max(1, kinds.sum())
    out = {b"": float(low.min()) or 1 / 256} | {bytes([b]): float(low[b]) for b in range(256)}
    for a in range(256):
        if n := pairs[a].sum():
            back = DISCOUNT * (pairs[a] > 0).sum() / n
            row = np.maximum(pairs[a] - DISCOUNT, 0) / n + back * low
            out |= {bytes([a, b]): float(row[b]) for b in range(256)}
    return out


def difference(words: list[Counter], pairs: np.ndarray) -> dict[bytes, float]:
    """Log-probability differences, toxic less ordinary: of each gram that either class has seen, and of each seen context (a zero byte after it) that of backing off."""
    shared = shared_table(pairs)
    plain, toxic = (KneserNey(w, shared) for w in words)
    out: dict[bytes, float] = {}
    for seen in (toxic.left, plain.left):  # one after another: no set of all
        for g in seen:
            if g not in out:
                out[g] = math.log(toxic.p(g) / plain.p(g))
    for seen in (toxic.total, plain.total):
        for h in seen:
            out[h + b"\0"] = math.log(toxic.back.get(h, 1.0) / plain.back.get(h, 1.0))
    return out


def word_difference(word: bytes, table: dict[bytes, float]) -> float:
    t, total = b" " + word + b" ", 0.0
    get = table.get
    for i in range(SHARED, len(t)):
        for at in range(max(0, i + 1 - ORDER), i + 1 - SHARED):
            d = get(t[at : i + 1])
            if d is not None:
                total += d
                break
            total += get(t[at:i] + b"\0", 0.0)
    return total


class Scorer:
    """The length-normalised difference of texts; remembers short words up to a bound."""

    KEPT, SHORT = 60_000, 64

    def __init__(self, table: dict[bytes, float], margin: float | None = MARGIN):
        self.table, self.margin, self.memo = table, margin, {}

    def __call__(self, raw: bytes) -> float:
        words = words_of(raw)
        if not words:
            return 0.0
        memo, total = self.memo, 0.0
        for w in words:
            d = memo.get(w)
            if d is None:
                d = word_difference(w, self.table)
                if self.margin is not None:
                    d = max(0.0, d - self.margin)
                if len(w) <= self.SHORT:
                    if len(memo) >= self.KEPT:
                        memo.clear()
                    memo[w] = d
            total += d
        return total / len(words)


def spread(figures: np.ndarray, margin: float | None = MARGIN) -> np.ndarray:
    """What the curve is over: the logarithm of figures above a margin, tenths of plain ones."""
    return 10 * figures if margin is None else np.log(figures + 0.002)


def fit_curve(figures: np.ndarray, y: np.ndarray, margin: float | None = MARGIN) -> tuple[float, float]:
    """Slope and intercept of a logistic curve; classes weigh alike and a small ridge keeps separable data finite."""
    z = np.stack([spread(figures, margin), np.ones_like(figures)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    at = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-3 * at * [1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


class Model:
    def __init__(self, table: dict[bytes, float], slope: float, intercept: float, margin: float | None = MARGIN):
        self.table, self.slope, self.intercept, self.margin = table, slope, intercept, margin

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * spread(figures, self.margin) + self.intercept, -700, 700)))


def sampled(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int, text: str, key: str, most: int = SAMPLE_BYTES) -> DataFrame:
    """``(y, half, t)`` of the texts that are fitted; the halves of a class alternate in the order of the sample."""
    known = known_labels(labels, "toxic", key, folds, fold)
    # the bounded sample is chosen by key, before any text is read
    ranked = [known.where(F.col("y") == c).orderBy(F.md5(F.col(key).cast("string")), key).limit(sample) for c in (0, 1)]
    first = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("x")
    texts = written(docs.select(key, text).join(F.broadcast(ranked[0].union(ranked[1])), key).groupBy(key, "y").agg(first).select(key, "y", F.coalesce("x.t", F.lit("")).alias("t")), "sample")
    order: list[list] = [[], []]  # at most ``sample`` keys of each class
    for r in texts.select(key, "y", F.octet_length("t").alias("n")).orderBy("y", F.md5(F.col(key).cast("string")), key).collect():
        order[r.y].append(r)
    used = []
    for c in (0, 1):
        room, kept = most, 0
        for r in order[c]:  # a text that doesn't fit is passed over, and so takes nothing from the others
            if r.n <= room:
                used.append((r[key], kept % 2))
                room, kept = room - r.n, kept + 1
    halves = docs.sparkSession.createDataFrame(used, f"{key} {docs.schema[key].dataType.simpleString()}, half int")
    return written(texts.join(F.broadcast(halves), key).select("y", "half", "t"), "halves")


def word_counts(texts: DataFrame) -> list[list[Counter]]:
    """Of each class and half, in how many texts each word stands; counted on the executors."""

    def run(batch: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for y, half, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            found.update((y, half, w) for w in set(words_of(raw)))
        return {"y": [k[0] for k in found], "half": [k[1] for k in found], "word": [k[2] for k in found], "n": list(found.values())}

    counts = [[Counter() for _ in range(2)] for _ in range(2)]
    rows = by_batch(texts.select("y", "half", "t"), run, "y int, half int, word binary, n long").groupBy("y", "half", "word").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # distinct words of the bounded sample
        counts[r.y][r.half][bytes(r.word)] = r.n
    return counts


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", margin: float | None = MARGIN, most: int = SAMPLE_BYTES) -> Model:
    texts = sampled(docs, labels, folds, fold, sample, text, key, most)
    counts = word_counts(texts)
    whole = [c[0] + c[1] for c in counts]
    if not all(whole):
        return Model({}, 0.0, 0.0, margin)
    pairs = pair_counts(written(vocabulary(docs, text), "vocabulary"))
    shared = docs.sparkSession.sparkContext.broadcast([difference([counts[c][k] for c in (0, 1)], pairs) for k in (0, 1)])  # bounded by the sample
    del counts  # the driver holds one of these at a time
    trimmed()

    def run(batch: pa.RecordBatch) -> dict:
        score = [Scorer(t, margin) for t in reversed(shared.value)]  # a half is scored by models of the other half
        figures = [score[half](raw) for half, raw in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)))]
        return {"y": batch.column(0), "figure": figures}

    rows = sorted((r.y, r.figure) for r in by_batch(texts, run, "y int, figure double").collect())
    y, figures = (np.array([r[k] for r in rows], dtype=float) for k in (0, 1))
    shared.destroy()
    table = difference(whole, pairs)
    del whole
    trimmed()
    return Model(table, *fit_curve(figures, y, margin), margin)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` for every row."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(shared)
        figures = np.fromiter((scorer(x) for x in as_bytes(batch.column(1))), dtype=float, count=batch.num_rows)
        return {key: batch.column(0), "score": pa.array(shared.value.scores(figures))}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, score double")


def with_score(docs: DataFrame, model: Model, text: str = "text", to: str = "toxic_score") -> DataFrame:
    """``docs`` with the score in one more column; its columns go by place, so names may clash."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(shared)
        figures = np.fromiter((scorer(x) for x in as_bytes(batch.column(place))), dtype=float, count=batch.num_rows)
        return {n: batch.column(k) for k, n in enumerate(names)} | {"score": pa.array(shared.value.scores(figures))}

    fields = [f"{n} {docs.schema[k].dataType.simpleString()}" for k, n in enumerate(names)]
    out = by_batch(docs.toDF(*names), run, ", ".join([*fields, "score double"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), F.col("score").alias(to))


def _scorer(shared) -> Scorer:
    """One scorer for a Python worker and model, so that remembered words serve all its batches."""
    model = shared.value
    return held(model, lambda: Scorer(model.table, model.margin))


def judged(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` for every document."""
    scored = score(docs, train(docs, labels, folds, fold, text=text, key=key), text, key)
    return scored.select(key, held_out(key, folds, fold).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
