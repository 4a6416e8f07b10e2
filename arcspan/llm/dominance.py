"""Weighted dominance counts: for each row, the rows no later than it that stand strictly higher.

Rows with one slot and level are first summed to one *point*. Points are put
in slot order, a slot group by falling level, so that a point's dominators are
exactly the points before it with a strictly higher level: inside a slot group
everything higher comes first, and what ties in level never counts. What is
left is a weighted count of inversions, taken by an external merge sort:

1. range partitions of that order are the first runs (``run_rows`` points on
   average, held in memory by one task each, counted by the same merge in
   numpy);
2. up to ``fan`` neighbouring runs are merged by level, round after round. A
   point of run ``c`` is credited with what has been merged of the earlier runs
   before it, all of it higher. A merge is cut into blocks of level ranges, one
   task each; what the blocks above hold of each run (``fan`` sums a block) is
   summed by a window and carried into the block;
3. the credits are joined to the rows by slot and level.

So no task holds more than a run or a block, however many rows share a slot or
level (Spark splits the skewed side of the last join), nothing is broadcast by
hand and the driver sees one count. Every round is a written table.

Defined cases: a null slot or level (also from a total that is no finite
number in the range of a long) is above nothing and gets null counts; a null
identifier stands for one row; repeated rows count each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import dropped, trimmed, written

#: Points a first run and a block have on average, runs merged at once, runs merged at once in memory.
RUN_ROWS, FAN, INNER_FAN = 1 << 19, 32, 4


def slot(df: DataFrame, at: str, seconds: int = 3600) -> Column:
    """Whole ``seconds`` since 1970, the clock taken as UTC in any session zone; null for null."""
    if isinstance(df.schema[at].dataType, TimestampNTZType):
        since = F.expr(f"(`{at}` - TIMESTAMP_NTZ '1970-01-01 00:00:00')")
        whole = F.expr(f"(`{at}` - TIMESTAMP_NTZ '1970-01-01 00:00:00') DIV INTERVAL '{seconds}' SECOND")
        return F.when(since < whole * F.expr(f"INTERVAL '{seconds}' SECOND"), whole - 1).otherwise(whole)
    return F.floor(F.unix_seconds(at) / seconds)


def level(total: str) -> Column:
    """The whole units of an amount rounded to hundredths, in double arithmetic; null where that is no long."""
    cents = F.col(total).cast("double") * 100.0 + 0.5
    return F.when(F.abs(cents) < 9.0e18, F.floor(F.floor(cents).cast("double") / 100.0))


def copies(key: str) -> Column:
    """The equal rows that a row stands for: 1 + (crc32 of the key in decimal ASCII, mod 2); 1 without a key."""
    return F.lit(1) + F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2, F.lit(0))


def credit(child: np.ndarray, weights: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """What each point of one merged group gets from earlier children merged before it.

    The points come in merge order: by falling level, ties by falling child.
    ``weights`` has a row a measure, ``carried`` (measure, child) what was
    merged of each child before the first point.
    """
    out, seen = np.zeros_like(weights), np.zeros_like(weights)
    before = np.zeros(len(weights), dtype=np.int64)
    at = 0
    for c in np.unique(child):
        before += carried[:, at:c].sum(axis=1)
        own = child == c
        out[:, own] = before[:, None] + np.cumsum(seen, axis=1)[:, own]
        seen[:, own] = weights[:, own]
        at = c
    return out


def credit_within(levels: np.ndarray, weights: np.ndarray, fan: int = INNER_FAN) -> np.ndarray:
    """What each point of a run gets from earlier, strictly higher ones; the points come in run order."""
    n = len(levels)
    out, place = np.zeros_like(weights), np.empty(n, dtype=np.int64)
    place[np.lexsort((-np.arange(n), -levels))] = np.arange(n)  # by falling level, ties by falling position
    order, width = np.arange(n), 1
    while width < n:
        group, child = order // (width * fan), order // width % fan
        merge = np.argsort(group * n + place[order], kind="stable")
        order, group, child = order[merge], group[merge], child[merge]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, n])
        seen = np.zeros_like(weights)
        for c in range(1, fan):
            earlier = child == c - 1
            seen[:, earlier] = weights[:, order[earlier]]
            sums = np.cumsum(seen, axis=1)
            own = child == c
            base = np.repeat(np.where(first > 0, sums[:, first - 1], 0), sizes, axis=1)
            out[:, order[own]] += (sums - base)[:, own]
        width *= fan
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one run and counts inside it."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    slots, levels, n, w, run = (rows.column(c).to_numpy() for c in ("slot", "level", "n", "w", "run"))
    order = np.lexsort((-levels, slots))
    weights = np.stack([n[order], w[order]])
    up = credit_within(levels[order], weights)
    yield from pa.table({"slot": slots[order], "level": levels[order], "n": weights[0], "w": weights[1], "run": run[order], "up_n": up[0], "up_w": up[1]}).to_batches(1 << 16)
    del got, rows
    trimmed()


def _block(fan: int):
    def merged(points: pa.Table, carry: pa.Table) -> pa.Table:
        group, levels, child = (points.column(c).to_numpy() for c in ("grp", "level", "child"))
        order = np.lexsort((-child, -levels, group))
        points = points.take(pa.array(order))
        group, child = group[order], child[order]
        weights = np.stack([points.column(c).to_numpy() for c in ("n", "w")])
        up = np.stack([points.column(c).to_numpy() for c in ("up_n", "up_w")])
        before = {}
        for g, c, n, w in zip(*(carry.column(x).to_pylist() for x in ("grp", "child", "n", "w")), strict=True):
            before.setdefault(g, np.zeros((2, fan), dtype=np.int64))[:, c] = n, w
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for i, j in zip(first, np.r_[first[1:], len(group)] if len(group) else []):
            up[:, i:j] += credit(child[i:j], weights[:, i:j], before.get(group[i], np.zeros((2, fan), dtype=np.int64)))
        out = points.select(["slot", "level", "n", "w", "run"])
        return out.append_column("up_n", pa.array(up[0])).append_column("up_w", pa.array(up[1]))

    return merged


_POINT = "slot long, level long, n long, w long, run long, up_n long, up_w long"


def _merged(runs: DataFrame, width: int, fan: int, tasks: int) -> DataFrame:
    """One round: ``fan`` neighbouring groups of ``width`` runs each become one."""
    placed = runs.withColumns({"grp": F.expr(f"run DIV {width * fan}"), "child": F.expr(f"run DIV {width} % {fan}")})
    dealt = placed.repartitionByRange(tasks, F.col("grp"), F.col("level").desc(), F.col("child").desc())
    blocks = written(dealt.withColumn("block", F.spark_partition_id().cast("long")), "blocks")
    sums = blocks.groupBy("grp", "child", "block").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    # a group's blocks are neighbours: what a block holds of a child is carried into each later block of the group, also
    # into those without a point of that child
    spans = blocks.select("grp", "block").distinct()
    every = spans.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(fan - 1)).cast("array<long>")))
    above = Window.partitionBy("grp", "child").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.join(sums.hint("merge"), ["grp", "child", "block"], "left").select("grp", "child", "block", *(F.sum(c).over(above).alias(c) for c in ("n", "w"))).where("n > 0").toDF("grp", "child", "block", "n", "w")
    out = blocks.groupBy("block").cogroup(carry.groupBy("block")).applyInArrow(_block(fan), _POINT)
    return written(out, "runs")


def credits(points: DataFrame, run_rows: int = RUN_ROWS, fan: int = FAN) -> DataFrame:
    """``(slot, level, up_n, up_w)`` of distinct points ``(slot, level, n, w)``: sums over the points that dominate."""
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // run_rows))
    ordered = points.repartitionByRange(tasks, F.col("slot"), F.col("level").desc())
    runs = written(ordered.withColumn("run", F.spark_partition_id().cast("long")).mapInArrow(_run, _POINT), "runs")
    width = 1
    while width < tasks:
        merged = _merged(runs, width, fan, tasks)
        dropped(runs)
        runs, width = merged, width * fan
    return runs.select("slot", "level", "up_n", "up_w")


def dominated(rows: DataFrame, key: str, at: str, amount: str, run_rows: int = RUN_ROWS, fan: int = FAN) -> DataFrame:
    """``key``, ``slot``, ``level``, ``n_above`` and ``w_above`` of every row."""
    placed = rows.select(F.col(key), slot(rows, at).cast("long").alias("slot"), level(amount).cast("long").alias("level"))
    whole = placed.where("slot IS NOT NULL AND level IS NOT NULL")
    points = whole.groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(copies(key)).alias("w"))
    found = credits(written(points, "points"), run_rows, fan)
    counted = whole.join(found.hint("merge"), ["slot", "level"], "left").select(key, "slot", "level", F.coalesce("up_n", F.lit(0)).alias("n_above"), F.coalesce("up_w", F.lit(0)).alias("w_above"))
    none = F.lit(None).cast("long")
    return counted.unionByName(placed.where("slot IS NULL OR level IS NULL").select(key, "slot", "level", none.alias("n_above"), none.alias("w_above")))
