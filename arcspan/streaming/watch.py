"""Watching files: debounced batches, rescans one at a time, and incremental graphs."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events ``(watch_id, ts, path)`` until a quiet ``gap``: ``watch_id, started, ended, n_events, paths``.

    Works on tables and streams; a stream also needs ``late``, after which a
    session is final.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("watch_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select("watch_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "paths")


def on_batches(batches: DataFrame, rescan: Callable[[DataFrame, int], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """A rescan for each micro-batch; the next waits while one runs, and takes all that came meanwhile.

    Results are appended to ``sink`` as JSON, one folder a batch, so that a
    repeated batch replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            rescan(batch, number).write.mode("overwrite").json(os.path.join(sink, f"batch={number}"))

    return batches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").start()


class SingleFlight:
    """Runs a function for requests that come from any thread: one at a time, and once more if any came meanwhile."""

    def __init__(self, run: Callable[[str], None]):
        self._run, self._lock, self._busy, self._next = run, threading.Lock(), False, None

    def request(self, reason: str) -> None:
        with self._lock:
            if self._busy:
                self._next = reason
                return
            self._busy = True
        while True:
            self._run(reason)
            with self._lock:
                if self._next is None:
                    self._busy = False
                    return
                reason, self._next = self._next, None


def refreshed(edges: DataFrame, changed: DataFrame, removed: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after a change: those of changed and removed files give way to the new ones; links to removed files become warnings."""
    gone = removed.select("id")
    kept = edges.join(changed.select(F.col("id").alias("src")).union(gone), "src", "left_anti")
    rows = kept.unionByName(new_edges)
    broken = rows.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    warnings = broken.select(F.lit("resolve-failed").alias("code"), F.col("src").alias("file"), F.col("specifier").alias("detail"))
    return rows.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns), warnings


def needs_full_scan(added: int, unknown: int, config_changed: bool, has_globs: bool) -> bool:
    """New files, unknown ones, changed configuration and expanded imports can change edges of files that did not change."""
    return bool(added or unknown or config_changed or has_globs)


def cache_key(**parts) -> str:
    """A digest of all that a scan depends on: tool, root, configuration, options."""
    import hashlib

    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cache_outcome(key_before: str | None, key_now: str, manifest_changes: dict[str, int]) -> str:
    """``miss, invalidated, fresh`` or ``incremental``, from the kept key and counts of manifest changes."""
    if key_before is None:
        return "miss"
    if key_before != key_now or manifest_changes.get("added"):
        return "invalidated"
    return "incremental" if manifest_changes.get("changed") or manifest_changes.get("removed") else "fresh"
