"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash bands find pairs, the shingles decide.

A text is the set of its shingles of five words (a shorter one is a single
shingle, one without words has none). 24 bands of five minima each bring two
texts of similarity s together with probability 1 - (1 - s**5)**24, which is
0.9999 at 0.8. Every pair that is linked has its shingles compared in full.

Operator 3's method comes first: texts whose SimHash fingerprints (here of these
shingles) differ in two bits or fewer are candidates, by its index over byte
positions. It can't bring all texts of that similarity together: at 0.8 two
fingerprints differ in about ten bits spread over nearly all of their bytes (the
README has the figures), so MinHash adds what the index misses.

In a bucket of up to ``SMALL`` texts all pairs are candidates. In a larger one
each text meets one leader, so a group of n near copies costs n candidates for
each band and never n * n; the leader is chosen in one of four orders, so that
texts which miss one leader meet others in other bands.

Texts that share a template stand in large buckets and are unlike most leaders.
Buckets whose texts the links found so far don't make one class are open: all of
their texts go on by a prefix filter. A text's shingles are put in order by how
many of these texts have them, and two texts of similarity s or more have one of
their rarest ``(1 - s) n + 1`` in common. What only one text has is passed over,
so a template's own shingles don't come up. In each list all pairs of texts of
different classes are candidates, but for those that their lengths and the places
of the shingle rule out. So of texts that share a bucket no link between classes
is left out.

Defined cases: texts without words are one class; texts of fewer words than a
shingle are one shingle; repeated rows are one node; an empty table gives no
links; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import simhash
from .common import as_bytes, by_batch, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SMALL, ORDERS, DEAL, SEED = 24, 5, 8, 4, 512, 43
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    text = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(text, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, stops = [0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
    return np.unique(np.array([h(text[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band of minima; all texts without shingles share theirs."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(found), 256):
        np.minimum(low, (found[k : k + 256, None] * _FACTORS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in low.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def node(text: str = "text") -> Column:
    """The number of a text: equal texts are one node."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _round(open_: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``(k, v, node)`` to distinct pairs ``(a, b)``, ``a`` the smaller, and the members of buckets too large for all pairs; each turn has leaders of its own.

    A leader is the first of a bucket in one of the orders, pre-aggregated as a minimum.
    """
    first = F.min(F.struct(F.xxhash64("node", F.col("k") % ORDERS, F.lit(turn)).alias("at"), F.col("node").alias("leader")))
    shared = written(open_.groupBy("k", "v").agg(first.getField("leader").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = written(open_.join(shared, ["k", "v"]), "met")
    near = met.where(F.col("n") <= SMALL).groupBy("k", "v").agg(F.collect_list("node").alias("xs"))
    near = near.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b"))
    large = met.where(F.col("n") > SMALL).drop("n")
    led = large.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return near.union(led).where("a < b").distinct(), large.select("k", "v", "node")


def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``lists`` (``k, v, node`` and more) those whose members are of more than one class ``(node, root)``, with the class."""
    named = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("k", "v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k", "v")
    return named.join(several, ["k", "v"], "left_semi")


def all_pairs(lists: DataFrame) -> DataFrame:
    """``v, node, root, n, at`` to all distinct pairs ``(a, b)`` of different classes in one list that may be similar.

    ``n`` is a text's number of shingles, ``at`` the place of ``v`` in its order.
    If ``v`` is the first that two texts share, they share no more than what
    comes behind it in either, which bounds their similarity. A large list is
    dealt out by one side of its pairs, so no task has all of them.
    """
    deals = lists.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("deals"))
    dealt = lists.join(deals, "v")
    side = lambda x, deal: dealt.select("v", deal.alias("deal"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "at")))
    met = side("a", F.pmod(F.xxhash64("node"), F.col("deals"))).join(side("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals").cast("bigint") - 1))), ["v", "deal"])
    least = (F.col("n_a") + F.col("n_b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    met = met.where("node_a < node_b AND root_a <> root_b").where(1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def index_pairs(prints: DataFrame) -> DataFrame:
    """``(node, fp)`` to distinct pairs ``(a, b)``, ``a`` the smaller, by operator 3's index.

    Of equal fingerprints each text meets the smallest one, of near ones the smallest meet: as many pairs as the index has links.
    """
    nodes = prints.select("node", "fp").distinct()
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = simhash.near_links(heads.select("fp")).distinct().join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return same.union(near.select(F.least("x", "y"), F.greatest("x", "y"))).where("a < b").distinct()


def rare_postings(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """``k, v, node, n, at``: the texts of open buckets (``node``) listed under their rarest shingles, the ``at``-th of their ``n``.

    ``sets`` has ``node, s``. Shingles are counted over these texts alone; the
    counts are pre-aggregated, and a text's own list is as long as the text.
    """
    members = open_.select("node").distinct()

    def split(batch: pa.RecordBatch) -> dict:
        found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        return {"node": batch.column(0), "s": pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))}

    rows = by_batch(sets.join(members, "node", "left_semi"), split, "node long, s array<long>")
    rows = written(rows.select("node", F.size("s").alias("n"), F.explode("s").alias("v")), "postings")
    common = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "v"))
    # those of one text alone come first, all alike: they only move the others' places
    shared = rows.join(common, "v")
    among = shared.select("node", "n", "v", "df", place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("many"))
    reach = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-9)) + 1
    at = F.col("n") - F.col("many") + F.col("place")
    return among.where(at <= reach).select(F.lit(BANDS).alias("k"), "v", "node", "n", at.alias("at"))


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs ``(a, b)`` of the nodes of texts with a similarity of ``SIMILARITY`` or more."""
    texts = docs.select(node(text).alias("node"), F.col(text).alias("t"))

    def banded(batch: pa.RecordBatch) -> dict:
        found, fps = [], []
        for x in as_bytes(batch.column(1)):
            own = shingles(x)
            found.append(bands(own))
            fps.append(simhash.majority(own))
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        return {"node": batch.column(0), "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(flat))}

    def listed(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "s": [shingles(x).tobytes() for x in as_bytes(batch.column(1))]}

    def compared(batch: pa.RecordBatch) -> dict:
        a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
        ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
        return {"a": [v for v, k in zip(a, ok) if k], "b": [v for v, k in zip(b, ok) if k]}

    prints = written(by_batch(texts, banded, "node long, fp long, bands array<long>"), "bands")
    open_ = prints.dropDuplicates(["node"]).select("node", F.posexplode("bands").alias("k", "v"))
    pairs, large = _round(open_, 0)
    pairs = written(pairs.union(index_pairs(prints)).distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()  # the texts of large buckets are in these pairs too
    sets = written(by_batch(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), listed, "node long, s binary"), "shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return written(by_batch(full, compared, "a long, b long"), "alike")

    found = alike(pairs)
    if large.isEmpty():
        return found
    roots = components(found)
    open_ = written(mixed(large, roots), "open")
    if open_.isEmpty():
        return found
    lists = written(mixed(written(rare_postings(sets, open_), "prefixes"), roots), "open")
    return found.union(alike(written(all_pairs(lists).join(pairs, ["a", "b"], "left_anti"), "candidates")))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, ``node`` and ``root``, the smallest node that links reach."""
    found = components(links(docs, text))
    return docs.select(key, node(text).alias("node")).join(found, "node", "left").select(key, "node", F.coalesce("root", "node").alias("root"))


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each class: of the smallest key (null last), among texts of one key that of the smallest node.

    Keys needn't be distinct: rows that share one, or have none, are told apart by their texts.
    The join and the choice among repeated rows share one shuffle.
    """
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("node"))).alias("x")
    named = lambda column: F.coalesce(column.cast("string"), F.lit(""))
    keep = classes(docs, text, key).groupBy("root").agg(first).select(F.col("x.node").alias("_node"), F.col("x.none").alias("_none"), named(F.col("x.key")).alias("_key"))
    at = ["_node", "_none", "_key"]
    rows = docs.withColumns({"_node": node(text), "_none": F.col(key).isNull(), "_key": named(F.col(key))})
    return rows.join(keep, at, "left_semi").dropDuplicates(at).select(*docs.columns)
