"""Best-fit packing by matching large items first.

Only lengths matter to a packing, and there are at most ``capacity`` of them,
so the packing is planned on a histogram: bounded work and memory on the
driver for any corpus. Documents above a third of the capacity come first: at
most two of them share a sequence, so each, from the largest down, is matched
with the largest remaining one that fits beside it. Smaller documents, again
from the largest down, go where the least room is left that holds them. The
plan is a list of runs (so many sequences with the same contents); a piece
finds its place from its length and its rank among the pieces of that length.

Ranks need neither a sort nor one task for a frequent length: a task that cuts
pieces numbers those of each length as it goes, which is stored with them, and
what the tasks before it have of that length (one sum for each task and length)
is added.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed each (ranks count rows, not keys); a text of any length is cut into full pieces and a rest; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_batch, held, written

CAPACITY, END = 4096, 1
SLICE = 1 << 21  # a slice's tables of chunks take some 25 times as much for a moment


class Words(dict):
    """Ids of blank-free chunks as little-endian bytes, remembered up to a bound.

    The tokenizer drops white space before it looks for tokens, so a text's
    ids are those of its chunks one after another. It lower-cases all but its
    special tokens; lower-casing ASCII before makes fewer chunks. A token ends
    where an ASCII letter or digit and ASCII punctuation meet (the apostrophe
    of a contraction aside), so chunks are split there too. The pieces of many
    texts are told apart by their bytes as numbers, so that each different one
    is looked up once.
    """

    KEPT = 120_000  # twice as many with those that were used before these

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if b"<|" in t or b"\0" in t:  # special tokens keep their case; zeros would pass for a chunk's end
                chunks = (t if b"<|" in t else t.lower()).translate(_BLANKS).split(b" ")
                known = self.known(list(dict.fromkeys(chunks)))
                out[k] = b"".join(map(known.__getitem__, chunks))
            else:
                plain.append(k)
        if plain:
            for k, found in zip(plain, self._many([texts[k] for k in plain])):
                out[k] = found
        return out

    def _many(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts).lower().translate(_BLANKS)
        data = np.frombuffer(b" " + joined + b" " * 17, dtype=np.uint8)
        kinds = _KIND[data]
        meet = kinds[:-1] << 2 | kinds[1:]
        start, end = (np.nonzero(x[meet])[0] + 1 for x in (_BEGINS, _ENDS))
        del kinds, meet
        if not len(start):
            return [b""] * len(texts)
        n = end - start
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        low = words[start] & mask[np.minimum(n, 8)]
        high = words[np.minimum(start + 8, len(words) - 1)] & mask[np.clip(n - 8, 0, 8)]
        raw = data.tobytes()
        seen: dict[bytes, int] = {}
        for k in np.nonzero(n > 16)[0].tolist():  # a number for each long chunk
            low[k], high[k] = seen.setdefault(raw[start[k] : end[k]], len(seen)), 0
        key = np.where(n <= 8, low, (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7)) ^ n.astype(np.uint64) << np.uint64(57))
        order = np.argsort(key)
        new = np.append(True, np.diff(key[order]) != 0)
        group = np.empty(len(key), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        del key, order, new
        at = first[group]
        differ = np.nonzero((low != low[at]) | (high != high[at]) | (n != n[at]))[0]
        if len(differ):  # chunks whose keys are equal by chance have groups of their own
            group[differ] = len(first) + np.arange(len(differ))
            first = np.append(first, differ)
        del low, high, n, at
        chunks = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        known = list(map(self.known(chunks).__getitem__, chunks))
        flat, sizes = np.frombuffer(b"".join(known), dtype="<u4"), np.array(list(map(len, known))) // 4
        each = sizes[group]
        upto = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[group] - (upto - each), each) + np.arange(upto[-1])].tobytes()
        begin = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.append(0, upto)[np.searchsorted(start, begin)].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(cut, cut[1:])]

    def known(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different chunks; they are remembered from now on, and the oldest half may be forgotten."""
        out, old, new = {}, self.old, []
        for c, i in zip(chunks, map(self.get, chunks)):
            if i is None and (i := old.get(c)) is None:
                new.append(c)
            else:
                out[c] = i
        texts = {c.decode(): c for c in new}
        words = [t for t in texts if t.isalpha()]
        found: dict[bytes, bytes] = {}
        for k in range(0, len(words), 1000):
            found.update((texts[t], i) for t, i in self._words(words[k : k + 1000]))
        found.update((texts[t], i) for t, i in self._each([t for t in texts if not t.isalpha()]))
        out.update(found)
        if len(self) + len(out) > self.KEPT:
            self.old = dict(self)
            self.clear()
        self.update(out if len(out) < self.KEPT else found)
        return out

    def _each(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        return [(c, array("I", e.ids).tobytes()) for k in range(0, len(chunks), 20_000) for c, e in zip(chunks[k : k + 20_000], self.tokenizer.encode_batch_fast(chunks[k : k + 20_000], add_special_tokens=False))]

    def _words(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Many words in one call; the last token of each is marked as a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.nonzero(self.ending[ids])[0] + 1) * 4
        if len(ends) != len(words):  # a word that lower-cases to more than letters
            return self._each(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [(w, raw[a:b]) for w, a, b in zip(words, [0, *ends], ends)]


# 0 blank, 1 ASCII letters and digits, 2 ASCII punctuation, 3 all else (the apostrophe, other characters' bytes)
_KIND = np.array([0 if c == 32 else 1 if chr(c).isalnum() and c < 128 else 2 if 33 <= c < 127 and c != 39 else 3 for c in range(256)], dtype=np.uint8)
_MEET = [(a, b) for a in range(4) for b in range(4)]
_BEGINS = np.array([b > 0 and (a == 0 or {a, b} == {1, 2}) for a, b in _MEET])
_ENDS = np.array([a > 0 and (b == 0 or {a, b} == {1, 2}) for a, b in _MEET])
_BLANKS = bytes(32 if c in b"\t\n\r" else c for c in range(256))
def _words(path: str) -> Words:
    return held(sys.intern(path), lambda: Words(path))


def _path(tokenizer: str) -> str:
    """A file's path, or the name of a file of the tokenizers every machine has installed."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: each document's ids and the end token, cut where they exceed the capacity.

    ``task`` and ``nth`` (the pieces of that length this task has made before) tell equal lengths apart.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END], dtype="<u4").tobytes()
    made: dict = {}  # of the task that runs: pieces by length

    def numbered(length: list[int]) -> tuple[list[int], list[int]]:
        at = TaskContext.get()
        if made.get("attempt") != at.taskAttemptId():
            made.update(attempt=at.taskAttemptId(), n=Counter())
        nth, n = [], made["n"]
        for x in length:
            nth.append(n[x])
            n[x] += 1
        return [at.partitionId()] * len(length), nth

    def run(batch: pa.RecordBatch) -> dict:
        words = _words(_path(tokenizer))
        texts = as_bytes(batch.column(1))
        row, piece, start, length, crc = [], [], [], [], []
        at = 0
        while at < len(texts):  # a few megabytes at a time
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE):
                size += len(texts[upto])
                upto += 1
            for k, ids in enumerate(words.ids(texts[at:upto]), at):
                ids += end
                for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = upto
        return {key: batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc} | dict(zip(("task", "nth"), numbered(length)))

    return by_batch(docs.select(key, text), run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """From pieces by length: ``(sequences, [(length, how many of it in each), ...])`` for every run of equal sequences."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        if at < 0 or (large[at] == a and left[a] == 1 and at == 0):
            n, contents = left[a], [(a, 1)]
        else:
            if large[at] == a and left[a] == 1:
                at -= 1
            b = large[at]
            n, contents = (left[a] // 2, [(a, 2)]) if a == b else (min(left[a], left[b]), [(a, 1), (b, 1)])
        runs.append((n, contents))
        for length, k in contents:
            left[length] -= n * k
            if not left[length]:
                del left[length]
                large.pop(bisect_left(large, length))
    room: dict[int, list[int]] = {}  # runs by the room left in their sequences
    for k, (_, contents) in enumerate(runs):
        room.setdefault(capacity - sum(n * c for n, c in contents), []).append(k)
    open_ = sorted(room)

    def file(k: int, gap: int) -> None:
        if gap not in room:
            room[gap] = []
            insort(open_, gap)
        room[gap].append(k)

    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            at = bisect_left(open_, s)
            if at == len(open_):
                each = capacity // s
                runs.append((max(1, c // each), []))
                file(len(runs) - 1, capacity)
                continue
            gap = open_[at]
            k = room[gap].pop()
            if not room[gap]:
                del room[gap]
                open_.pop(at)
            n, contents = runs[k]
            each = min(gap // s, c)
            full = min(n, c // each)
            if full < n:  # the others stay as they are
                runs[k] = (n - full, contents)
                file(k, gap)
                runs.append((full, [*contents, (s, each)]))
                k = len(runs) - 1
            else:
                runs[k] = (n, [*contents, (s, each)])
            file(k, gap - s * each)
            c -= full * each
    return runs


def placements(runs: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """``(length, first rank)`` keys, ascending, and ``(first sequence, each, offset)`` of them."""
    keys, values, used, first = [], [], {}, 0
    for n, contents in runs:
        offset = 0
        for length, each in contents:
            keys.append((length, used.get(length, 0)))
            values.append((first, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        first += n
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return np.array([keys[k] for k in order], dtype=np.int64).reshape(-1, 2), np.array([values[k] for k in order], dtype=np.int64).reshape(-1, 3)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece, with ``sequence_id`` and ``offset``."""
    rows = written(pieces(docs, tokenizer, capacity, text, key), "pieces")
    made = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # a window over the tasks, not over the rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = written(made.select("length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    keys, values = placements(plan(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((keys, values))  # bounded by the lengths there are
    ranked = rows.join(before.drop("n").hint("merge"), ["length", "task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        keys, values = shared.value
        length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 5))
        wide = 1 << 44
        at = np.searchsorted(keys[:, 0] * wide + keys[:, 1], length * wide + rank, side="right") - 1
        first, each, offset = values[at].T
        inside = rank - keys[at, 1]
        return {f.name: batch.column(k) for k, f in enumerate(batch.schema) if k < 5} | {"sequence_id": pa.array(first + inside // each), "offset": pa.array(offset + inside % each * length)}

    return by_batch(ranked, run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
