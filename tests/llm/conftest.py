import random

import pytest

WORDS = [a + b for a in ("er", "an", "the", "in", "ou", "ti") for b in ("", "on", "re", "st", "ha", "é")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


#: Null, empty, blank, one word, repeated rows, a very long text, a null key; columns whose names clash with ours.
ODD = [
    (1, prose(80, 1), "en", "src0", "k", 0), (2, prose(80, 1), "en", "src0", "x", 1), (2, prose(80, 1), "en", "src0", "x", 1), (3, None, None, None, None, None), (4, "", "de", "src1", "", 2),
    (5, " \t\n ", "fr", "src2", "t", 3), (6, "word", "es", "src3", "m", 4), (7, prose(30000, 7), "en", "src0", "c", 5), (8, "x" * 60000, "en", "src5", "a", 6), (None, prose(60, 8), "en", "src9", "n", 7),
    (9, prose(300, 9) + "\nSame line here.\nSame line here.\n\0\x0b tail", "en", "src0", "k", 8), (10, "Ünïcödé ✓ 中文 " * 40, "en", "src0", "fp", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, k string, fp long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("k", "score").withColumnRenamed("fp", "n_words")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def odd_rows():
    return ODD
