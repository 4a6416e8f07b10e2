"""Stored scans: kept graphs to compare with, and a cache that a rescan takes unchanged files from.

The cache of a project holds a manifest (path and stamp of every file), what
the parser said of each file and where its imports lead, in partitions by path
hash, and the tables of the last scan. A rescan compares manifests first:

- nothing changed: the stored tables are read, no text is;
- else only new and changed files are parsed. Imports of other files are
  resolved again where a file that came or went is one of the places they look
  at (the other side of the probes: three places a file), so a change goes back
  along the edges it can alter; all other links are carried over. Partitions
  that hold a changed file are replaced;
- another configuration, aliases, framework or version of the tables: all files
  are parsed (:func:`needs_full_scan`).

The result equals that of a full scan. A rescan that dies leaves the key
removed, so the next one starts anew.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import grown, ship, written
from ..sources import parse, resolve
from ..streaming.watch import cache_key, cache_outcome, needs_full_scan
from .config import Config
from .scan import Base, Scan, based, discovered, imports_of, links_of, measured, read

VERSION, BUCKETS = 1, 64
LINKS = ("src", "n", "kind", "specifier", "approximate", "confidence", "pattern", "bases", "dst")


def keep(base: Base, path: str) -> None:
    """Writes a base; the same path replaces itself."""
    for f in fields(Base):
        getattr(base, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def kept(spark: SparkSession, path: str) -> Base:
    return Base(*(spark.read.parquet(f"{path}/{f.name}").hint("merge") for f in fields(Base)))


def note(spark: SparkSession, path: str, **facts) -> None:
    """A few facts as one row of JSON."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.mode("overwrite").parquet(path)


def noted(spark: SparkSession, path: str) -> dict:
    """What :func:`note` wrote, {} if nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    row = spark.read.parquet(path).first()
    return json.loads(row.facts) if row else {}


def stamp(sources: DataFrame):
    """What tells a file's versions apart: size and time where the listing has them, else a hash of the text."""
    if {"size", "mtime"} <= set(sources.columns):
        return F.concat_ws("|", F.col("size").cast("string"), F.unix_micros("mtime").cast("string"))
    return F.xxhash64("content").cast("string")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def _replaced(df: DataFrame, key: str, path: str, only: DataFrame | None = None) -> None:
    """Writes a table by buckets, all of them or those of ``only`` (``bucket``); what is read may be what is replaced."""
    rows = _bucketed(df, key)
    how = "static"
    if only is not None:
        rows, how = written(rows.join(F.broadcast(only), "bucket", "left_semi"), "replaced"), "dynamic"  # BUCKETS rows at most
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("bucket").parquet(path)
    if only is not None:  # a partition that has lost all its rows isn't written, so it has to go
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for r in only.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():  # BUCKETS at most
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r.bucket}")
            at.getFileSystem(conf).delete(at, True)


def rescanned(
    spark: SparkSession, sources: DataFrame, path: str, config: Config | None = None, aliases: list = (), framework: str = "generic",
    html: DataFrame | None = None, chunks: DataFrame | None = None,
) -> tuple[Scan, str]:
    """The scan of ``sources`` through the cache at ``path``, and what the cache could do (see :func:`refreshed`).

    What the scan found is kept beside its base; while neither files nor
    settings nor what else it was given change, it is read and not made again.
    """
    ship(spark)
    config = config or Config()
    base, outcome = refreshed(spark, sources, path, config, aliases, framework)
    given = {k: _digest(df, columns) for k, df, columns in (("html", html, ["content"]), ("chunks", chunks, ["chunk_id", "path", "size"]))}
    key = cache_key(version=VERSION, today=config.today if config.suppressions else None, **given)
    if outcome == "fresh" and noted(spark, f"{path}/found/key").get("key") == key:
        return _found(spark, path, base, framework), outcome
    note(spark, f"{path}/found/key", key=None)
    scan = measured(base, config, framework, html, chunks)
    own = {f.name: getattr(scan, f.name) for f in fields(Scan) if isinstance(getattr(scan, f.name), DataFrame)}
    for name, table in own.items():
        if name not in SHARED:
            table.write.mode("overwrite").parquet(f"{path}/found/{name}")
    note(spark, f"{path}/found/key", key=key, tables=sorted(own))
    return _found(spark, path, base, framework), outcome


#: Tables of a scan that its base holds.
SHARED = tuple(f.name for f in fields(Base))


def _digest(df: DataFrame | None, columns: list[str]) -> str | None:
    """One number of all rows in any order."""
    if df is None:
        return None
    return str(df.agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first())


def _found(spark: SparkSession, path: str, base: Base, framework: str) -> Scan:
    names = noted(spark, f"{path}/found/key")["tables"]
    own = {n: getattr(base, n) if n in SHARED else spark.read.parquet(f"{path}/found/{n}") for n in names}
    return Scan(**({"bundle": None} | own), base=base, framework=framework)


def refreshed(spark: SparkSession, sources: DataFrame, path: str, config: Config | None = None, aliases: list = (), framework: str = "generic") -> tuple[Base, str]:
    """The base of ``sources`` (``rel_path, content``, from listings also ``size, mtime``) through the cache at ``path``.

    With it one of ``miss, invalidated, incremental, fresh``: what the cache could do.
    """
    ship(spark)
    config = config or Config()
    settings = {k: v for k, v in dataclasses.asdict(config).items() if k != "today"}
    key = cache_key(version=VERSION, config=settings, aliases=[list(a) for a in aliases], framework=framework)
    before = noted(spark, f"{path}/key").get("key")
    found = discovered(sources, config)
    listed = found.select("rel_path", stamp(found).alias("stamp"))
    changes = None
    if before == key:
        old = spark.read.parquet(f"{path}/manifest")
        both = listed.join(old.withColumnRenamed("stamp", "was"), "rel_path", "full")
        what = F.when(F.col("was").isNull(), "added").when(F.col("stamp").isNull(), "removed").when(F.col("stamp") != F.col("was"), "changed")
        changes = grown(both.select("rel_path", what.alias("what")).where("what IS NOT NULL"), "changes")
    counts = {r.what: r.n for r in changes.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()} if changes is not None else {}
    outcome = cache_outcome(before, key, {k: v for k, v in counts.items() if k != "added"} | ({"changed": counts["added"]} if "added" in counts else {}))
    if outcome == "fresh":
        return kept(spark, f"{path}/base"), outcome
    if before is not None:
        note(spark, f"{path}/key", key=None)
    if needs_full_scan(0, 0, before != key, False):
        parsed = grown(parse.parse(found, callees=tuple(x["name"] for x in config.loaders)), "parsed")
        wanted = imports_of(parsed, config)
        links = written(links_of(wanted, parsed.select("rel_path"), list(aliases)).select(*LINKS), "links")
        base = based(parsed, found, wanted, links, config, framework)
        touched = None
    else:
        parsed, wanted, links, probed, touched = _carried(spark, found, changes, path, config, list(aliases))
        base = based(parsed, found, wanted, links, config, framework, probed)
    # everything that is read from the cache is written before any of it is replaced
    base = Base(*(grown(getattr(base, f.name), f.name) for f in fields(Base)))
    _replaced(parsed, "rel_path", f"{path}/parsed", touched)
    _replaced(links, "src", f"{path}/links", None)
    written(listed, "manifest").write.mode("overwrite").parquet(f"{path}/manifest")
    keep(base, f"{path}/base")
    note(spark, f"{path}/key", key=key)
    return base, outcome


def _carried(spark: SparkSession, found: DataFrame, changes: DataFrame, path: str, config: Config, aliases: list):
    """Parsed files, imports, links and probes after a change, from those before; and the buckets that changed."""
    gone = changes.where("what <> 'added'").select("rel_path")
    fresh = found.join(changes.where("what <> 'removed'").select("rel_path"), "rel_path", "left_semi")
    new = grown(parse.parse(fresh, callees=tuple(x["name"] for x in config.loaders)), "parsed")
    old = spark.read.schema(_bucketed(new, "rel_path").schema).parquet(f"{path}/parsed").drop("bucket").join(gone, "rel_path", "left_anti")
    parsed = grown(old.unionByName(new), "parsed")
    moved = changes.where("what <> 'changed'").select(F.explode(resolve.bases_of(F.col("rel_path"))).alias("base")).distinct()
    links = spark.read.parquet(f"{path}/links").select(*LINKS).join(gone.withColumnRenamed("rel_path", "src"), "src", "left_anti")
    links = grown(links, "links")
    altered = links.select("src", "n", F.explode("bases").alias("base")).join(moved, "base", "left_semi").select("src", "n").distinct()
    altered = grown(altered, "altered")
    # imports of changed files, and those of others that look where something came or went
    again = imports_of(new, config).unionByName(links.join(altered, ["src", "n"], "left_semi").select(*LINKS[:7]))
    resolved = links_of(again, parsed.select("rel_path"), aliases).select(*LINKS)
    after = grown(links.join(altered, ["src", "n"], "left_anti").select(*LINKS).unionByName(resolved), "links")
    stale = changes.select(F.col("rel_path").alias("src"))
    probed = grown(spark.read.parquet(f"{path}/base/probed").join(stale, "src", "left_anti"), "probed")
    buckets = _bucketed(changes, "rel_path").select("bucket").distinct()
    return parsed, imports_of(parsed, config), after, probed, buckets


__all__ = ["keep", "kept", "note", "noted", "read", "rescanned", "stamp"]
