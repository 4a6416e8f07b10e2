"""How far sources differ in the words they use: exact divergences of term counts between the sources of a language.

Terms are maximal runs of letters and characters beyond ASCII, A-Z lower-cased.
A language keeps the terms of at least ``MIN_DOCS`` of its documents (rows), V
of them. A group is a language and a source; a group, and the language as a
whole, gives each kept term with count c there the share
``p = 1 + floor(SCALE * (c + 2) / (N + 2 * V))``, N the sum of its counts. Two
shares differ by ``f = floor((p - q)^2 / (p + q))``. All of it is whole-number
arithmetic.

Sources are compared on *distinct count vectors*: terms of a language with the
same counts in the same sources are one vector with a multiplicity, and a pair
of sources is evaluated once a vector. Vectors are sparse. A source that lacks
a term still gives it a share, which depends on the source alone (``z``), so
for sources a and b

    sum over vectors with both of  m * (f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb))
    + sum over terms of a of f(pa, zb) + sum over terms of b of f(za, pb)
    + (V - terms of a - terms of b) * f(za, zb)

is the sum over all V terms, and only pairs that meet in a vector are ever
made. The middle sums run over distinct shares of a source.

Terms are counted in Python tasks that hold at most ``HELD`` counts and hand on
partial sums; all else is DataFrame code, summed before it is shuffled. A
vector is as long as its term has sources, whose square the result has anyway.

Defined cases: null texts, languages and sources read as empty strings; a
language without kept terms gives pairs of value 0 and no terms; a source alone
in its language gives no pairs; repeated rows are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_CONF, as_bytes, trimmed, written

MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Counts a task holds before it hands them on.
HELD = 500_000

_LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
#: A-Z to a-z; all other ASCII to blanks, so that a split gives the terms.
_TERMS = bytes((b | 32 if b < 91 else b) if b in _LETTERS else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _counted(most: int):
    """Partial ``(lang, source, term, n, docs)`` of a partition, of at most about ``most`` counts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.partition(" ")[0] for x in _COUNTS.split(", ")]
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, docs) in groups.items():
                keys = list(seen)
                for i in range(0, len(keys), 1 << 15):
                    part = keys[i : i + (1 << 15)]
                    text = pa.array(part, pa.binary()).cast(pa.string())
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), text, pa.array([seen[k] for k in part], pa.int64()), pa.array([docs[k] for k in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            groups.clear()
            trimmed()

        held = 0
        for batch in batches:
            for raw, lang, source in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = Counter(terms(raw))
                seen, docs = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
                held -= len(seen)
                seen.update(found)
                docs.update(found.keys())
                held += len(seen)
                if held >= most:
                    yield from flushed()
                    held = 0
        yield from flushed()

    return run


def counts(docs: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """Occurrences and documents of every term of every group."""
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    partial = docs.select(text, "lang", "source").mapInArrow(_counted(held), _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, whole: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / whole)``, exact at any count; null where ``whole`` is 0."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {SCALE}BD) DIV CAST(nullif({whole}, 0) AS DECIMAL(20, 0))")


def difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV (({p}) + ({q}))"


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def group_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group with V, what its shares are divided by, its number of kept terms and its share ``z`` of a term it lacks."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    entries = kept.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source"))
    own = entries.agg(F.sum("e.n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    out = groups.join(sizes, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "total", "n_terms"])
    return out.withColumn("whole", F.expr("total + 2 * v")).withColumn("z", share("0L", "whole"))


def pair_values(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` of every two sources a < b of a language."""
    shares = stats.select("lang", "source", "whole", "z")
    entries = vectors.select("lang", "vid", "m", F.explode("vec").alias("e")).select("lang", "vid", "m", "e.source", "e.n")
    entries = written(entries.join(shares, ["lang", "source"]).select("lang", "vid", "m", "source", "z", share("n", "whole").alias("p")), "entries")

    met = entries.groupBy("lang", "vid", "m").agg(F.collect_list(F.struct("source", "p", "z")).alias("es")).where(F.size("es") > 1)
    met = met.select("lang", "m", "es", F.explode("es").alias("a")).select("lang", "m", "a", F.explode(F.filter("es", lambda x: x["source"] > F.col("a.source"))).alias("b"))
    change = f"{difference('a.p', 'b.p')} - {difference('a.p', 'b.z')} - {difference('a.z', 'b.p')} + {difference('a.z', 'b.z')}"
    met = met.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.expr(f"SUM(m * ({change}))").alias("value"))

    own = entries.groupBy("lang", "source", "p").agg(F.sum("m").alias("m")).withColumnRenamed("source", "own")
    alone = own.join(shares, "lang").where("own <> source")
    alone = alone.groupBy("lang", F.least("own", "source").alias("a"), F.greatest("own", "source").alias("b")).agg(F.expr(f"SUM(m * ({difference('p', 'z')}))").alias("value"))

    left = stats.select("lang", F.col("source").alias("a"), "v", F.col("n_terms").alias("na"), F.col("z").alias("za"))
    right = stats.select("lang", F.col("source").alias("b"), F.col("n_terms").alias("nb"), F.col("z").alias("zb"))
    lacked = left.join(right, "lang").where("a < b").select("lang", "a", "b", F.expr(f"COALESCE((v - na - nb) * ({difference('za', 'zb')}), 0L)").alias("value"))
    return lacked.unionByName(alone).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources and each group's ``TOP`` terms."""
    names = F.sort_array(F.collect_list(F.struct("source", "n")))
    kept = counts(docs, text, held).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), names.alias("vec")).where(F.col("docs") >= MIN_DOCS)
    kept = written(kept.select("lang", "term", "vec"), "kept")
    stats = written(group_stats(docs, kept), "groups")
    vectors = kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")).withColumn("vid", F.monotonically_increasing_id())

    pairs = written(pair_values(written(vectors, "vectors"), stats), "pairs")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    langs = stats.groupBy("lang").agg(F.expr("SUM(total) + 2 * MAX(v)").alias("lang_whole"))
    whole = kept.withColumn("total", F.expr("aggregate(vec, 0L, (s, e) -> s + e.n)")).join(langs, "lang").withColumn("q", share("total", "lang_whole"))
    own = whole.select("lang", "term", "q", F.explode("vec").alias("e")).select("lang", F.col("term").alias("item"), "q", "e.source", "e.n")
    own = own.join(stats.select("lang", "source", "whole"), ["lang", "source"]).withColumn("p", share("n", "whole")).where("p > q")
    top = _ranked(own.withColumn("value", F.expr(difference("p", "q"))), "term").where(F.col("rank") <= TOP)
    return _ranked(pairs, "pair").unionByName(top)
