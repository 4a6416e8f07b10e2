"""SimHash near-duplicates through an inverted index over byte positions.

A 64-bit fingerprint is eight bytes. Two fingerprints that differ in at most
two bits differ in at most two bytes, so they share at least six (position,
byte) postings: that is the guaranteed minimum the count filter asks for. A
tally pair by pair over single postings would be quadratic, as each of the
2,048 lists holds 1/256 of all rows. So the tally is moved into the key: a
fingerprint is posted once under each of the 28 choices of six positions, and
two of them meet in a list exactly if they share those six bytes, that is if
their tally reaches six. Lists are short by construction: their members can
only differ in the two bytes left, so none holds over 65,536 fingerprints,
whatever the input. Verification looks at these 16 bits.

Equal fingerprints are one row before anything is posted, and a list gives
each member one link to its group's smallest member, so a group of n near
copies costs n links for each list and never n * n pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import as_bytes, by_batch, written

BYTES, SEED, SHINGLE = 8, 42, 3


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles; of a shorter sequence the whole, of no words 0."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    else:
        starts, stops = [0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(text[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) if len(bits) < 1 << 22 else sum(b.sum(axis=0, dtype=np.int64) for b in np.array_split(bits, len(bits) >> 20))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)``; the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(x, shingle) for x in as_bytes(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
        return {key: batch.column(0), "fp": pa.array(found.view(np.int64))}

    return by_batch(docs.select(key, text), run, f"{key} {kind}, fp long")


def _flips(free: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << b for b in at) for n in range(distance + 1) for at in combinations(range(free), n)], dtype=np.int64)


def list_links(members: np.ndarray, shift: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one posting list: a link from each member to the smallest of its group.

    ``members`` are distinct fingerprints that agree outside the bytes at
    ``shift``; two are linked if those differ in at most ``distance`` bits,
    and a group is what links reach. A table over the free bits finds the
    neighbours, so the work is the members times the ways to flip bits.
    """
    low = np.zeros(len(members), dtype=np.int64)
    for k, s in enumerate(shift):
        low |= ((members >> np.uint64(s)) & np.uint64(255)).astype(np.int64) << (8 * k)
    order = np.argsort(members)
    root = np.empty(len(members), dtype=np.int64)
    root[order] = np.arange(len(members))
    rank = root.copy()
    flips = _flips(8 * len(shift), distance)
    if len(members) <= 64:
        differ = low[:, None] ^ low[None, :]
        near = np.isin(differ, flips)
        pairs = np.nonzero(near)
    else:
        place = np.full(1 << (8 * len(shift)), -1, dtype=np.int64)
        place[low] = np.arange(len(members))
        a, b = [], []
        for f in flips[1:]:
            to = place[low ^ f]
            at = np.nonzero(to >= 0)[0]
            a.append(at)
            b.append(to[at])
        pairs = np.concatenate(a), np.concatenate(b)
    while True:
        before = root.copy()
        np.minimum.at(root, pairs[0], before[pairs[1]])
        jump = root[order[root]]
        root = np.minimum(root, jump)
        if (root == before).all():
            break
    linked = root < rank
    return members[linked], members[order[root[linked]]]


def near_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct ``fp`` to links ``(a, b)`` that join all fingerprints within ``distance`` bits."""
    kept = BYTES - distance
    choices = list(combinations(range(BYTES), distance))  # the positions left free
    masks = [sum(0xFF << (8 * p) for p in range(BYTES) if p not in free) for free in choices]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if kept < 1:
        raise ValueError("the index needs a byte that must agree")
    posted = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks)))).alias("p"))
    # sets of at most 256 ** distance members: distinct rows that agree in all other bytes
    lists = posted.groupBy("p.k", "p.v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("k", "fps")

    def run(batch: pa.RecordBatch) -> dict:
        a, b = [], []
        for k, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
            members = np.asarray(fps.values, dtype=np.int64).view(np.uint64)
            x, y = list_links(members, np.array([8 * p for p in choices[k]], dtype=np.uint64), distance)
            a.append(x)
            b.append(y)
        both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return {"a": pa.array(both[0]), "b": pa.array(both[1])}

    return by_batch(lists, run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``fingerprint`` (hex) and ``component_id``, the smallest key reachable.

    Null and empty texts have fingerprint 0 and are linked like any other. A
    repeated row counts once for the component and gets the same answer. A
    null key never is a component's id unless the component has no other.
    """
    prints = written(fingerprints(docs, text, key, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("low")), "nodes")
    found = components(near_links(nodes.select("fp"), distance))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = member.join(roots, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
