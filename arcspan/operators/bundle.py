"""Bundles: which modules ship in which chunks, and what makes them heavy."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import live

#: Default limits.
HEAVY, DUPLICATES, SOLO, BARREL_LEAST, BARREL_SHARE = 500_000, 2, 0.8, 8, 0.8


def normal_path(path: Column, root: str = "") -> Column:
    """A bundler's module name as a project path: without query, loaders, backslashes, ``./`` and the root."""
    out = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), r"^.*!", "")
    out = F.regexp_replace(F.replace(out, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    root = root.rstrip("/")
    return F.when(F.lit(bool(root)) & out.startswith(f"{root}/"), F.substring(out, len(root) + 2, 1 << 30)).otherwise(out) if root else out


def attached(chunks: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds ``id``: the module by its path, without ``src/``, or with it; the first that exists."""
    tries = F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("id")), F.struct(F.lit(1).alias("rank"), F.regexp_replace("path", "^src/", "").alias("id")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("src/"), "path").alias("id")))
    paths = chunks.select("path").distinct()
    found = paths.select("path", F.explode(tries).alias("t")).select("path", "t.rank", "t.id").join(modules.select("id"), "id").groupBy("path").agg(F.min_by("id", "rank").alias("id"))
    return chunks.join(found, "path", "left")


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.sum("size").alias("chunk_size"))


def duplicates(rows: DataFrame, least: int = DUPLICATES) -> DataFrame:
    """Modules in several chunks: ``id, n_chunks, size, severity``; a chunk's size counts once."""
    once = rows.where("id IS NOT NULL").groupBy("id", "chunk_id").agg(F.max("size").alias("size"))
    out = once.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("size")).where(F.col("n_chunks") >= least)
    return out.withColumn("severity", F.when(F.col("n_chunks") >= 4, "high").when(F.col("n_chunks") >= 3, "medium").otherwise("low"))


def heavy(rows: DataFrame, limit: int = HEAVY) -> DataFrame:
    ratio = F.col("chunk_size") / limit
    return chunk_sizes(rows).where(F.col("chunk_size") >= limit).withColumn("severity", F.when(ratio >= 4, "high").when(ratio >= 2, "medium").otherwise("low"))


def solo_hot(rows: DataFrame, limit: int = HEAVY, share: float = SOLO) -> DataFrame:
    """Chunks (at least half as large as a heavy one) that one module of the project makes up."""
    tops = rows.groupBy("chunk_id").agg(F.sum("size").alias("chunk_size"), F.max(F.when(F.col("id").isNotNull(), F.struct("size", F.col("id")))).alias("top"))
    part = F.col("top.size") / F.col("chunk_size")
    out = tops.where((F.col("chunk_size") > 0) & (part >= share) & (F.col("chunk_size") >= limit / 2))
    return out.select("chunk_id", F.col("top.id").alias("id"), F.col("top.size").alias("size"), F.floor(part * 100 + 0.5).cast("long").alias("share"), F.when(F.col("chunk_size") >= limit, "high").otherwise("medium").alias("severity"))


def barrel_leaks(modules: DataFrame, edges: DataFrame, rows: DataFrame, least: int = BARREL_LEAST, share: float = BARREL_SHARE) -> DataFrame:
    """Index files that pull most of their folder into their own chunks."""
    barrels = modules.where(F.col("id").rlike(r"(^|/)index\.[cm]?[jt]sx?$")).select(F.col("id").alias("src"), F.regexp_replace("id", "[^/]*$", "").alias("dir"))
    targets = live(edges).select("src", "dst").distinct().join(barrels, "src").where("src <> dst AND startswith(dst, dir)")
    homes = rows.where("id IS NOT NULL").select("id", "chunk_id").distinct()
    together = targets.join(homes.withColumnRenamed("id", "src"), "src").join(homes.withColumnRenamed("id", "dst"), ["dst", "chunk_id"]).select("src", "dst").distinct().withColumn("with", F.lit(1))
    present = targets.join(homes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    out = present.join(together, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("n_targets"), F.count("with").alias("n_together"))
    return out.where((F.col("n_together") >= least) & (F.col("n_targets") >= least) & (F.col("n_together") / F.col("n_targets") >= share)).withColumn("severity", F.when(F.col("n_together") >= 2 * least, "high").otherwise("medium"))


def module_chunks(rows: DataFrame) -> DataFrame:
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("chunks"))


def rollup_leaves(tree: dict, prefix: str = "") -> list[tuple[str, int]]:
    """``(path, size)`` of the leaves of a visualizer's tree, without recursion."""
    out, todo = [], [(tree, prefix)]
    while todo:
        node, at = todo.pop()
        path = f"{at}/{node['name']}" if at and node.get("name") else node.get("name") or at
        if children := node.get("children"):
            todo += [(c, path) for c in reversed(children)]
        else:
            out.append((path, int(node.get("value") or node.get("size") or 0)))
    return out


def webpack_modules(stats: DataFrame, root: str = "") -> DataFrame:
    """``chunk_id, path, size`` from a stats document (a row with ``chunks``)."""
    c = stats.select(F.explode("chunks").alias("c")).select(F.col("c.id").cast("string").alias("chunk_id"), F.explode("c.modules").alias("m"))
    return c.select("chunk_id", normal_path(F.col("m.name"), root).alias("path"), F.col("m.size").cast("long").alias("size"))




def stats_rows(text: str) -> list[tuple[str, str, int]]:
    """``chunk_id, path, size`` of a bundler's statistics, [] for what is none: one document, as large as the bundler made it."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    if isinstance(data.get("chunks"), list):
        chunks = [c for c in data["chunks"] if isinstance(c, dict)]
        mods = [(str(c.get("id")), m) for c in chunks for m in c.get("modules") or [] if isinstance(m, dict)]
        return [(c, str(m.get("name", "")), int(m.get("size") or 0)) for c, m in mods]
    if isinstance(data.get("tree"), dict):
        tops = data["tree"].get("children") or []
        return [(str(t.get("name")), path, size) for t in tops for path, size in rollup_leaves({**t, "name": ""})]
    return []
