import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcspan.llm import packing

NAME = "word_bpe_49k.json"
HARD = ["  a b  c\x85d <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é ́x Å Å İI ΣΑΣ İstanbul ǅ", "don't we'll 1234 １２ \x0b\x0c a\x1cb it's. 's ''", "가 ᆨ ½, x²! ³. ẞß. ﬁ Ⅷ. 中文。 कि। á, xyz…, --a-- 9. a_b_ __"]


def expected(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    out = []
    for k, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(k, n, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], dtype="<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    return Counter(out)


def check(got):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_pieces_and_places(spark, odd, odd_rows):
    got = packing.packed(odd, NAME).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(odd_rows)
    check(got)
    rows = list(enumerate(HARD))
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), NAME).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(rows)


def test_repeated_keys_and_pieces_have_places_of_their_own(spark):
    rows = [(k % 3 if k % 4 else None, "same words again") for k in range(400)] + [(1, "longer " * 9000)] * 5
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), NAME).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    tokens = sum(r.length for r in got)
    assert check(got) <= -(-tokens // 4096) + 2


def test_empty_table(empty):
    assert packing.packed(empty, NAME).collect() == []


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(packing.Words, "KEPT", 50)
    words, plain = packing.Words(public_tokenizers.path(NAME)), Tokenizer.from_file(public_tokenizers.path(NAME))
    r = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(r.choice("abcdefg.,") for _ in range(r.randint(1, 4))) for _ in range(30))
        ids = words.ids([text.encode(), b""])
        assert np.frombuffer(ids[0], dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids and ids[1] == b""


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_everything(seed):
    r = random.Random(seed)
    counts = {n: r.randint(1, 60) for n in r.sample(range(1, 101), r.randint(1, 100))}
    runs = packing.plan(counts, 100)
    held = Counter()
    for n, contents in runs:
        assert n > 0 and sum(a * k for a, k in contents) <= 100 and sum(k for a, k in contents if 3 * a > 100) <= 2
        for a, k in contents:
            held[a] += n * k
    assert held == Counter(counts)
    # within a sequence of what first-fit by falling length needs
    bins = []
    for a in sorted((a for a, c in counts.items() for _ in range(c)), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= a), None)
        bins.append(100 - a) if k is None else bins.__setitem__(k, bins[k] - a)
    assert sum(n for n, _ in runs) <= len(bins) * 1.03 + 1


def test_plan_is_small_for_any_size():
    runs = packing.plan({n: 10**9 + n for n in range(1, 4097)})
    assert len(runs) < 40_000


def test_a_batch_takes_little_memory_beside_its_texts():
    """The texts of a slice: the tables of their chunks go before the ids are made."""
    import random
    import tracemalloc

    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    texts, size = [], 0
    while size < packing.SLICE:
        texts.append(" ".join(r.choice(words) for _ in range(400)).encode())
        size += len(texts[-1])
    made = packing.Words(public_tokenizers.path(NAME))
    made.ids(texts[:1])
    tracemalloc.start()
    made.ids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
