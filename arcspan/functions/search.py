"""A small search language over modules: ``path: export: import: kind:`` prefixes, quotes and free words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import live

PREFIXES = ("path", "export", "import", "kind")
_TOKEN = re.compile(r'(?:(path|export|import|kind):)?(?:"([^"]*)"|(\S+))')


@dataclass
class Query:
    prefixes: dict[str, list[str]] = field(default_factory=dict)
    words: list[str] = field(default_factory=list)


def parse(text: str) -> Query:
    out = Query()
    for prefix, quoted, plain in _TOKEN.findall(text):
        value = quoted or plain
        if value and prefix:
            out.prefixes.setdefault(prefix, []).append(value)
        elif value:
            out.words.append(value)
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def search(modules: DataFrame, edges: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """``id, score``: all prefixes must match (one of a prefix's values each), free words rank.

    ``modules`` has ``id, kind, exports``. Paths ignore case, exports and
    imports don't. Without prefixes a free word must match; with them a module
    stays at 0.5 if no word does. Ties go to the shorter id.
    """
    q = parse(text)
    rows = modules
    if values := q.prefixes.get("path"):
        rows = rows.where(_any([F.contains(F.lower("id"), F.lit(v.lower())) for v in values]))
    if values := q.prefixes.get("kind"):
        rows = rows.where(F.col("kind").isin(*values))
    if values := q.prefixes.get("export"):
        rows = rows.where(F.exists("exports", lambda e: _any([F.contains(e, F.lit(v)) for v in values])))
    if values := q.prefixes.get("import"):
        rows = rows.join(live(edges).where(_any([F.contains("specifier", F.lit(v)) for v in values])).select(F.col("src").alias("id")), "id", "left_semi")
    base = F.lower(F.regexp_replace(F.regexp_extract("id", "([^/]*)$", 1), r"\.[^.]*$", ""))
    total: Column = F.lit(0.0)
    for word in q.words:
        w = F.lit(word.lower())
        named = F.when(F.exists("exports", lambda e: F.lower(e) == w), 0.5).when(F.exists("exports", lambda e: F.contains(F.lower(e), w)), 0.25).otherwise(0.0)
        at = F.when(base == w, 0.4).when(F.contains(F.lower("id"), w), 0.2).otherwise(0.0)
        total = total + F.greatest(named, at)
    if q.words:
        score = F.least(F.lit(1.0), total / (len(q.words) * 0.5))
        rows = rows.withColumn("score", score)
        rows = rows.withColumn("score", F.when(F.col("score") > 0, F.col("score")).otherwise(0.5)) if q.prefixes else rows.where("score > 0")
    else:
        rows = rows.withColumn("score", F.lit(0.5))
    return rows.orderBy(F.col("score").desc(), F.length("id"), "id").limit(limit).select("id", "score")


def module_matches(modules: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """An exact id alone, else ids that contain the text, the shortest first."""
    found = modules.select("id").where(F.contains("id", F.lit(text)))
    exact = F.max((F.col("id") == text).cast("int"))
    has = found.agg(exact.alias("has"))
    return found.crossJoin(F.broadcast(has)).where((F.coalesce("has", F.lit(0)) == 0) | (F.col("id") == text)).orderBy(F.length("id"), "id").limit(limit).select("id")
