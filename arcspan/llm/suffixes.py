"""Repeated passages by suffix arrays: bytes under a string that also starts elsewhere.

One array over a large corpus would be one machine's work, so suffixes that
can share ``WIDTH`` bytes are brought together first, and each such block is
sorted by itself.

*Blocks.* A window (``WIDTH`` bytes that start somewhere in a text) has the
smallest hash of its ``GRAM``-byte strings as its mark. Equal windows have
equal marks, so a window whose mark stands nowhere else is unique.
Neighbouring windows mostly share their mark; a run of them with its bytes
(the windows and what they reach) is one row, about one for every 90 bytes.
Where all runs of a mark are the same bytes, all their windows repeat (bytes are
told apart by a 64-bit hash within the runs of one 64-bit mark, 128 bits
together). Where they differ, as at the ends of a shared passage or around an edit, one run of
each content goes to the mark's block; so does a run that holds its mark twice,
as its own windows may be equal.

*Suffix arrays.* Two-stage sorting: only suffixes smaller than their
successors are sorted directly; all others follow from a scan of the buckets,
smallest first byte first, in which each suffix hands on the one before it.
Then adjacent common prefixes of the window starts are computed: windows that
share ``WIDTH`` bytes with a neighbour repeat.

Texts are shuffled twice, to meet the runs that blocks ask for and to meet all
that repeats. A hot mark is one row a map task before it is shuffled
(a count and two extremes); joins with marks may split hot partitions. A mark
with over ``HOT`` contents (a phrase that stands in a large part of all texts,
each time between other words) has no block: the windows of its contents are
counted by their own 128-bit hashes, pre-aggregated, so no task holds them.

Defined cases: null and empty texts have no bytes, texts under ``WIDTH`` bytes
lose none; repeated rows count as places of their own, so each loses all its
windows; texts may hold any bytes and be of any length; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_batch, dropped, written

WIDTH, GRAM, LONGEST_RUN, CHUNK = 200, 16, 256, 1 << 19
HOT = 1 << 14  # contents of a mark that are sorted together at most: under eight megabytes
FILL = 1 << 19  # bytes of small groups that share a sort
LENGTH_BITS = 10  # an interval is its start and, in the lowest bits, its length


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes that start at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:  # hashes of twice as many bytes from two neighbours
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
        step *= 2
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def sliding(x: np.ndarray, many: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``many`` neighbours."""
    size, span = len(x), 1
    while 2 * span <= many:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: size - many + 1], x[many - span :]) if many > span else x


def _marked_twice(hashes: np.ndarray, marks: np.ndarray, start: np.ndarray, stop: np.ndarray, many: int) -> np.ndarray:
    """Of each run: does its mark stand at two places, as it must where two of its own windows are equal?"""
    edge = np.zeros(many - 1, dtype=np.uint64)
    place = np.nonzero(hashes == sliding(np.concatenate([edge, marks, edge]), many, np.maximum))[0]
    low, high = np.searchsorted(place, start), np.searchsorted(place, stop + many - 1)
    times, k = np.zeros(len(start), dtype=np.int64), 0
    alive = np.arange(len(start))
    while len(alive := alive[(low[alive] + k < high[alive]) & (times[alive] < 2)]):
        times[alive] += hashes[place[low[alive] + k]] == marks[start[alive]]
        k += 1
    return times > 1


def runs_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, mark, content hash, marked twice)`` of all runs of some texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(texts)
    if len(joined) < width:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes, many = gram_hashes(np.frombuffer(joined, dtype=np.uint8)), width - GRAM + 1
    marks = sliding(hashes, many, np.minimum)
    first = np.concatenate([[0], np.cumsum(sizes)])
    # windows that reach into the next text belong to none
    owned = np.zeros(len(joined) + 1, dtype=np.int8)
    fits = sizes >= width
    np.add.at(owned, first[:-1][fits], 1)
    np.add.at(owned, first[1:][fits] - width + 1, -1)
    owned = np.cumsum(owned[:-1], dtype=np.int8)[: len(marks)].astype(bool)
    new = owned.copy()
    new[1:] &= (marks[1:] != marks[:-1]) | ~owned[:-1]
    new[first[:-1][fits]] = True
    start = np.nonzero(new)[0]
    ends = np.nonzero(owned & ~np.append(owned[1:], False))[0] + 1  # of stretches of owned windows
    stop = np.minimum(np.append(start[1:], len(marks)), ends[np.searchsorted(ends, start, side="right")])
    parts = -(-(stop - start) // LONGEST_RUN)
    if (parts > 1).any():  # very regular text: a mark may hold for long
        base = np.repeat(start, parts)
        part = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.minimum(np.repeat(stop, parts), base + (part + 1) * LONGEST_RUN)
        start = base + part * LONGEST_RUN
    h = xxhash.xxh3_64_intdigest
    content = np.fromiter((h(joined[a:b]) for a, b in zip(start.tolist(), (stop + width - 1).tolist())), dtype=np.uint64, count=len(start))
    text = np.searchsorted(first, start, side="right") - 1
    # empty texts share their place with the next one: take the last that begins there
    return text, start - first[text], stop - start, marks[start], content, _marked_twice(hashes, marks, start, stop, many)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    Beyond ``depth`` bytes the order is open, but for suffixes that begin with
    so many equal bytes: those the two stages keep apart.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    differ = np.nonzero(text[1:] != text[:-1])[0]
    at = np.searchsorted(differ, np.arange(n))  # the next place where the byte changes
    rising = np.append(text[1:] > text[:-1], False)
    small = np.append(rising[differ], False)[np.minimum(at, len(differ))]  # smaller than the suffix after it
    view = np.ndarray((n,), dtype=f"S{depth}", buffer=np.append(text, np.zeros(depth, np.uint8)), strides=(1,))
    later: dict[int, list[np.ndarray]] = {}
    later.setdefault(int(text[-1]), []).append(np.array([n - 1]))  # larger than the empty suffix
    small_at = np.nonzero(small)[0]
    small_at = small_at[np.argsort(text[small_at], kind="stable")]
    bound = np.searchsorted(text[small_at], np.arange(257))
    out = []
    for c in np.unique(text).tolist():
        level = np.concatenate(later.pop(c, [np.zeros(0, dtype=np.int64)]))
        parts = []
        while len(level):
            parts.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == c]
        direct = small_at[bound[c] : bound[c + 1]]
        if len(direct) > 1:
            direct = direct[np.argsort(view[direct], kind="stable")]
        bucket = np.concatenate([*parts, direct])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.nonzero(np.diff(byte))[0] + 1
        for part in np.split(before, cuts) if len(before) else ():
            later.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix and the one before it in ``order``: equal leading bytes, ``depth`` at most, eight at a time."""
    out = np.zeros(len(order), dtype=np.int64)
    words = np.ndarray((len(text) + depth,), dtype="<u8", buffer=np.append(text, np.zeros(depth + 8, np.uint8)), strides=(1,))
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = words[order[alive] + k] ^ words[order[alive - 1] + k]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        same = np.where(differ == 0, 8, np.where(differ == 0, 0, np.log2(np.where(differ == 0, 1, low)).astype(np.int64) // 8))
        out[alive] += same
        alive = alive[differ == 0]
        if not len(alive):
            break
    return np.minimum(out, depth)


def repeated_windows(contents: list[bytes], width: int = WIDTH) -> np.ndarray:
    """For the windows of some contents (in order, all of them): does one equal another?"""
    text = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    windows = sizes - width + 1
    starts = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owned = np.zeros(len(text), dtype=bool)
    owned[starts] = True
    order = suffix_array(text, width)
    order = order[owned[order]]
    same = common_prefixes(text, order, width) >= width
    repeated = np.zeros(len(text), dtype=bool)
    repeated[order[same]] = True
    repeated[order[np.append(same[1:], False)]] = True
    # windows of one byte: the order may hold them apart
    changes = np.concatenate([[0], np.cumsum(text[1:] != text[:-1])])
    flat = starts[changes[starts] == changes[starts + width - 1]]
    for c in np.unique(text[flat]):
        at = flat[text[flat] == c]
        repeated[at] |= len(at) > 1
    return repeated[starts]


def _runs(docs: DataFrame, kind: str, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        texts, rows = as_bytes(batch.column(2)), []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
                size += len(texts[upto])
                upto += 1
            text, *rest = runs_of(texts[at:upto], width)
            rows.append((text + at, *rest))
            at = upto
        text, start, n, mark, content, twice = (np.concatenate(x) for x in zip(*rows)) if rows else runs_of([], width)
        which = pa.array(text)
        return {"k": batch.column(0).take(which), "th": batch.column(1).take(which), "m": pa.array(mark.view(np.int64)), "c": pa.array(content.view(np.int64)), "a": pa.array(start), "n": pa.array(n.astype(np.int32)), "twice": pa.array(twice)}

    return by_batch(docs.select("k", "th", "t").where(F.octet_length("t") >= width), run, f"k {kind}, th long, m long, c long, a long, n int, twice boolean")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's part of the values ends (a null has none), and the values."""
    sizes = np.array(pc.fill_null(pc.list_value_length(column), 0))
    return np.cumsum(sizes), column.flatten()


def _contents(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """The bytes of the runs that blocks need, from texts with their runs; rows repeated in a batch once."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("row", "m", "a", "single", "bytes")}
        ends, values = _lists(batch.column(3))
        marks, starts, sizes, single = (values.field(f).to_pylist() for f in ("m", "a", "n", "single"))
        keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seen, at = set(), 0
        for k, (raw, end) in enumerate(zip(as_bytes(batch.column(2)), ends.tolist())):
            if (keys[k], hashes[k]) not in seen:
                seen.add((keys[k], hashes[k]))
                out["row"] += [k] * (end - at)
                out["m"] += marks[at:end]
                out["a"] += starts[at:end]
                out["single"] += single[at:end]
                out["bytes"] += [raw[a : a + n + width - 1] for a, n in zip(starts[at:end], sizes[at:end])]
            at = end
        which = pa.array(out.pop("row"), pa.int64())
        return out | {"k": batch.column(0).take(which), "th": batch.column(1).take(which)}

    return by_batch(rows.select("k", "th", "t", "runs"), run, f"k {kind}, th long, m long, a long, single boolean, bytes binary")


def _sorted_blocks(contents: DataFrame, kind: str, width: int) -> DataFrame:
    """Intervals ``(k, th, x)`` of repeated windows in runs of which there is one; ``contents`` grouped by mark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"k {kind}, th long, x long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def found(rows: list[tuple]) -> Iterator[tuple]:
        repeated = repeated_windows([r[5] for r in rows], width).astype(np.int8)
        at = 0
        for k, th, _, a, single, content in rows:
            n = len(content) - width + 1
            if single:
                edge = np.diff(repeated[at : at + n], prepend=0, append=0)
                for x, y in zip(np.nonzero(edge > 0)[0].tolist(), np.nonzero(edge < 0)[0].tolist()):
                    yield k, th, (a + x) << LENGTH_BITS | y - x + width - 1
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # whole groups
        group: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(zip(*found(waiting))) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, group, size
            group = list({r[:2] + r[3:4]: r for r in group}.values())  # rows that are repeated
            if any(r[4] for r in group):  # a content alone can only repeat itself
                more = sum(len(r[5]) for r in group)
                if waiting and size + more > FILL:
                    yield flush()
                    waiting, size = [], 0
                waiting += group
                size += more
            group = []

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if group and group[0][2] != row[2]:
                    yield from close()
                group.append(row)
        yield from close()
        if waiting:
            yield flush()

    return contents.mapInArrow(run, schema)


def _counted_windows(contents: DataFrame, kind: str, width: int) -> DataFrame:
    """The same for marks that are too frequent to sort: every window is counted by its hash."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"k {kind}, th long, h long, g long, x long, single boolean"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = xxhash.xxh3_128_digest
        starts, single, contents = (batch.column(c).to_pylist() for c in (3, 4, 5))
        sizes = np.array([len(c) - width + 1 for c in contents])
        digests = np.frombuffer(b"".join(h(c[i : i + width]) for c, n in zip(contents, sizes.tolist()) for i in range(n)), dtype=">i8").reshape(-1, 2)
        which = np.repeat(np.arange(len(contents)), sizes)
        place = np.array(starts)[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.array(which)
        columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(digests[:, k].astype(np.int64)) for k in (0, 1)), pa.array(place << LENGTH_BITS | width), pa.array(np.array(single)[which])]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # at most 65,536 windows at a time
                yield hashed(batch.slice(a, 256))

    # a content that stands in several places is one here, as in blocks
    windows = contents.dropDuplicates(["m", "k", "th", "a"]).mapInArrow(run, schema)
    again = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    return windows.where("single").join(again, ["h", "g"]).select("k", "th", "x")


def _kept(rows: DataFrame, kind: str, key: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        ends, values = _lists(batch.column(2))
        packed, at = np.asarray(values), 0
        for raw, end in zip(as_bytes(batch.column(1)), ends.tolist()):
            gone = np.sort(packed[at:end])
            at = end
            if len(gone):
                first, last = gone >> LENGTH_BITS, np.maximum.accumulate((gone >> LENGTH_BITS) + (gone & (1 << LENGTH_BITS) - 1))
                apart = np.nonzero(first[1:] > last[:-1])[0]
                a, b = first[np.append(0, apart + 1)], last[np.append(apart, len(last) - 1)]
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
            else:
                a, kept = gone, raw
            for name, value in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(a)), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[name].append(value)
        return out | {key: batch.column(0)}

    return by_batch(rows.select("k", "t", "spans"), run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``n_bytes, n_removed, n_spans, kept_sha256``."""
    if width <= GRAM or width % 8 or width + LONGEST_RUN >= 1 << LENGTH_BITS:
        raise ValueError(f"the width must be a multiple of 8 over {GRAM}, and not too long")
    kind = docs.schema[key].dataType.simpleString()
    # a row is known by its key and a hash of its text: rows that agree in both have the same runs
    docs = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    runs = written(_runs(docs, kind, width), "runs")
    # a mark with one content everywhere, or with several
    marks = runs.groupBy("m").agg(F.count(F.lit(1)).alias("tot"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("twice").alias("twice")).where("tot > 1 OR twice").select("m", F.expr("lo = hi AND tot > 1").alias("same"))
    marks = written(marks, "marks")
    # hashed by partition: a mark is two numbers, so partitions sized for the runs hold their marks many times over
    shared = written(runs.drop("twice").join(marks.hint("shuffle_hash"), "m"), "shared")
    dropped(runs, marks)
    whole = F.shiftleft("a", LENGTH_BITS).bitwiseOR((F.col("n") + (width - 1)).cast("long")).alias("x")
    mixed = shared.where("NOT same")
    counts = written(mixed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("tot"), F.min(F.struct("k", "th", "a", "n")).alias("rep")), "counts")
    again = mixed.join(counts.where("tot > 1").select("m", "c"), ["m", "c"])
    # marks of which some content is there once
    open_ = counts.groupBy("m").agg(F.min("tot").alias("least"), F.count(F.lit(1)).alias("contents")).where("least = 1").select("m", (F.col("contents") > HOT).alias("hot"))
    asked = written(counts.join(open_, "m").select("rep.k", "rep.th", "hot", F.struct("m", "rep.a", "rep.n", (F.col("tot") == 1).alias("single")).alias("r")), "asked")
    runs_of = lambda hot: _contents(_with(docs, asked.where(F.col("hot") == hot).groupBy("k", "th").agg(F.collect_list("r").alias("runs")), "inner"), kind, width)
    found = written(_sorted_blocks(runs_of(False).repartition("m").sortWithinPartitions("m"), kind, width), "found")
    if asked.where("hot").limit(1).count():
        found = found.union(written(_counted_windows(runs_of(True), kind, width), "found"))
    spans = shared.where("same").select("k", "th", whole).union(again.select("k", "th", whole)).union(found).groupBy("k", "th").agg(F.collect_set("x").alias("spans"))
    return _kept(_with(docs, spans, "left"), kind, key)


def _with(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Joined by key (a null is one) and text hash."""
    more = more.withColumnsRenamed({"k": "k2", "th": "th2"})
    return docs.join(more, [F.col("k").eqNullSafe(F.col("k2")), F.col("th") == F.col("th2")], how).drop("k2", "th2")
