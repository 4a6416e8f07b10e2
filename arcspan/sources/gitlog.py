"""Change history from a saved log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = "__COMMIT__"
#: ``git log --no-merges --numstat --date=iso-strict --pretty=format:`` and this; fields end in byte 1.
FORMAT = f"{SENTINEL}%H%x01%ae%x01%an%x01%aI%x01%s"


def renamed(path: Column) -> tuple[Column, Column]:
    """New and old name of ``a/{b => c}/d`` and ``old => new``; the old one is null without a rename."""
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    tidy = lambda c: F.regexp_replace(c, "/+", "/")
    part = lambda k: F.regexp_extract(path, brace, k)
    has = path.rlike(brace)
    arrow = ~has & path.contains(" => ")
    new = F.when(has, tidy(F.concat(part(1), part(3), part(4)))).when(arrow, F.regexp_extract(path, "^.* => (.*)$", 1)).otherwise(path)
    old = F.when(has, tidy(F.concat(part(1), part(2), part(4)))).when(arrow, F.regexp_extract(path, "^(.*) => .*$", 1))
    return new, old


def parse(blocks: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Commits ``sha, author, author_name, authored_at, subject`` and changes ``sha, path, renamed_from, added, removed``."""
    rows = blocks.where(F.trim(value) != "").withColumn("lines", F.split(value, "\n"))
    head = F.split(F.element_at("lines", 1), "\u0001")
    rows = rows.withColumn("head", head).where(F.size("head") >= 5)
    commits = rows.select(F.trim(F.get("head", F.lit(0))).alias("sha"), F.lower(F.get("head", F.lit(1))).alias("author"), F.get("head", F.lit(2)).alias("author_name"), F.get("head", F.lit(3)).alias("authored_at"), F.get("head", F.lit(4)).alias("subject"))
    lines = rows.select(F.trim(F.get("head", F.lit(0))).alias("sha"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).withColumn("f", F.split("line", "\t")).where(F.size("f") == 3)
    new, old = renamed(F.get("f", F.lit(2)))
    number = lambda k: F.get("f", F.lit(k)).try_cast("long")  # noqa: E731  a dash stands for a binary file
    return commits, lines.select("sha", new.alias("path"), old.alias("renamed_from"), number(0).alias("added"), number(1).alias("removed"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A log of any size: commits are records, so the file is split among tasks."""
    return parse(spark.read.option("lineSep", SENTINEL).text(path))


def since_days(window: str) -> int:
    """``90d, 2w, 3m, 1y`` in days."""
    m = re.fullmatch(r"\s*(\d+)\s*([dwmy])\s*", window)
    if not m:
        raise ValueError(f"no such window: {window!r}")
    return int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]]


def within(commits: DataFrame, window: str, now: str) -> DataFrame:
    return commits.where(F.to_timestamp("authored_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {since_days(window)} DAYS"))
