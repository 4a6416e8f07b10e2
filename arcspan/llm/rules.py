"""Quality rules kept as a bit mask ledger.

Every rule is evaluated once for a document; the ledger holds its failure bits
and the measurements behind them and is stored (:func:`stored`). Policies are
versioned sets of rules that are applied to the stored bits, and an ablation
(what a policy would keep without one of its rules) is an aggregate over the
few distinct bit masks, so neither reads a text again, whichever and however
many versions are asked for.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_batch, written

#: Name and SQL condition over the measurements; the place in this list is the bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 60 * n_letters"),
    ("shouting", "100 * n_marks > 40 * n_words"),
]
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies; a document is kept if it fails none of a policy's rules.
POLICIES = {
    1: BASE_RULES,
    2: (*BASE_RULES, "symbols", "repeated_lines"),
    3: tuple(name for name, _ in RULES),
}
CURRENT = 3

_SYMBOLS = b"#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
_UPPER = bytes(range(65, 91))
_NOT_UPPER, _NOT_LETTER = bytes(set(range(256)) - set(_UPPER)), bytes(set(range(256)) - set(_UPPER) - set(range(97, 123)))
_NOT_SYMBOL, _NOT_MARK = bytes(set(range(256)) - set(_SYMBOLS)), bytes(set(range(256)) - {33})
_NO_START = bytes(set(range(256)) - set(range(128, 192)))


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def measure(raw: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``_MEASURES``."""
    words = raw.split()  # ASCII white space: the blank and bytes 9 to 13
    n, in_words = len(words), sum(map(len, words))
    continued = len(raw.translate(None, _NO_START)) if not raw.isascii() else 0
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    lines = raw.split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    gone = raw.translate(None, _NOT_LETTER)
    return (n, in_words - continued, len(raw.translate(None, _NOT_SYMBOL)), len(filled) - len(set(filled)), repeated, len(filled), len(gone.translate(None, _NOT_UPPER)), len(gone), len(raw.translate(None, _NOT_MARK)))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the key, every measurement and ``fail_bits``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*map(measure, as_bytes(batch.column(1))))) or [[]] * len(_MEASURES)
        return {key: batch.column(0)} | dict(zip(_MEASURES, map(list, rows)))

    measured = by_batch(docs.select(key, text), run, f"{key} {kind}, " + ", ".join(f"{m} long" for m in _MEASURES))
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The ledger written as Parquet, to ``path`` or the session's shared folder, and read back."""
    rows = ledger(docs, text, key)
    if path is None:
        return written(rows, "ledger")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def apply_policy(rows: DataFrame, version: int = CURRENT, to: str = "kept") -> DataFrame:
    """Adds a boolean column: no rule of that policy failed."""
    return rows.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents failing it, failing it alone, and kept without it.

    One pre-aggregated count per bit mask, then bitwise sums; at most
    ``2 ** len(RULES)`` rows reach the second step.
    """
    names = [name for name, _ in RULES]
    pairs = ", ".join(f"STRUCT({v}L AS policy, '{r}' AS rule, {mask(POLICIES[v])}L AS mask, {1 << names.index(r)}L AS bit)" for v in POLICIES for r in POLICIES[v])
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    long = counts.select("n", "fail_bits", F.explode(F.expr(f"ARRAY({pairs})")).alias("p")).select("n", "fail_bits", "p.*")
    total = lambda condition, to: F.expr(f"COALESCE(SUM(CASE WHEN {condition} THEN n END), 0L)").alias(to)
    return long.groupBy("policy", "rule").agg(total("(fail_bits & bit) <> 0", "n_failing"), total("(fail_bits & mask) = bit", "n_failing_alone"), total("(fail_bits & mask & ~bit) = 0", "n_kept_without"), total("(fail_bits & mask) = 0", "n_kept"))
