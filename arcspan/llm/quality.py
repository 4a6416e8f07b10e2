"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are computed once on the executors; training sees
only the statistics of a bounded sample of labelled rows (``SAMPLE``, those
whose key has the smallest hash) on the driver. Each tree is a complete one of
``DEPTH`` levels, flattened into arrays (feature and cut of an inner node,
value of a leaf), so a batch of documents goes down all trees in numpy: a step
is one comparison for all rows.

Defined cases: a null or empty text has all statistics 0; without labels of
both classes every score is the share of the known ones, or 0.5; repeated rows
get the same score; a key whose labels contradict each other teaches nothing,
and of several texts of one labelled key the smallest statistics are learnt
from, so no more than ``SAMPLE`` rows reach the driver; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_batch, held_out, known_labels
from .rules import measure

SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 80, 4, 64, 0.15, 1.0, 8
THRESHOLD = 0.7
STATISTICS = (
    "log_words", "mean_word", "symbol_share", "repeated_lines", "repeated_windows", "words_per_line", "upper_share", "mark_share",
    "digit_share", "letter_share", "stop_share", "comma_share", "distinct_words", "wide_share", "longest_word", "title_share",
)

_DIGITS, _LETTERS, _STOPS, _COMMAS = (bytes(set(range(256)) - set(x)) for x in (b"0123456789", bytes(range(65, 91)) + bytes(range(97, 123)), b".!?", b",;:"))
_WIDE = bytes(range(128))


def statistics(raw: bytes) -> tuple[float, ...]:
    n, chars, symbols, same_lines, repeated, lines, upper, letters, marks = measure(raw)
    if not raw:
        return (0.0,) * len(STATISTICS)
    words, size, w = raw.split(), len(raw), max(1, n)
    count = lambda drop: len(raw.translate(None, drop))
    return (
        float(np.log1p(n)), chars / w, symbols / size, same_lines / max(1, lines), repeated / w, n / max(1, lines), upper / max(1, letters), marks / w,
        count(_DIGITS) / size, count(_LETTERS) / size, count(_STOPS) / w, count(_COMMAS) / w, len(set(words)) / w, count(_WIDE) / size, float(max(map(len, words), default=0)),
        sum(x[:1].isupper() for x in words) / w,
    )


@dataclass
class Trees:
    """``feature`` and ``cut`` of shape (trees, inner nodes), ``value`` of shape (trees, leaves)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting on the logistic loss; each level of a tree is one histogram over (node, feature, bin)."""
    n, features = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    known = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(known / (1 - known)))
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, all_f, all_c, all_v = np.full(n, start), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            key = ((at - first)[:, None] * features + np.arange(features)) * BINS + binned
            hist = [np.bincount(key.ravel(), weights=np.repeat(a, features), minlength=nodes * features * BINS).reshape(nodes, features, BINS).cumsum(axis=2) for a in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, [a[:, :, -1:] for a in hist]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((nl >= LEAST) & (nt - nl >= LEAST), gain, 0.0)
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        value = -RATE * gs / (hs + RIDGE)
        margin = margin + value[leaf]
        all_f.append(feature)
        all_c.append(cut)
        all_v.append(value)
    return Trees(np.stack(all_f), np.stack(all_c), np.stack(all_v), start)


def with_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(map(statistics, as_bytes(batch.column(1))))
        return {key: batch.column(0), "stats": pa.array(rows, pa.list_(pa.field("element", pa.float64(), False)))}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Trees:
    known = known_labels(labels, "quality", key, folds, fold)
    chosen = F.broadcast(known.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample))  # at most ``sample`` rows of two numbers
    # of the texts of one key, the smallest statistics: a row for each key reaches the driver
    found = with_statistics(docs.select(key, text).join(chosen, key), text, key).groupBy(key).agg(F.min("stats").alias("stats"))
    rows = sorted((tuple(r.stats), r.y) for r in found.join(chosen, key).select("stats", "y").collect())
    return grow(np.array([r[0] for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r[1] for r in rows], dtype=float))


def judged(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, fold, text=text, key=key))  # a few thousand numbers
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in as_bytes(batch.column(1))]).reshape(batch.num_rows, len(STATISTICS))
        return {key: batch.column(0), "score": pa.array(model.value.scores(x))}

    scored = by_batch(docs.select(key, text), run, f"{key} {kind}, score double")
    return scored.select(key, held_out(key, folds, fold).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
