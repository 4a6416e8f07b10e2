"""Dominance counts against brute force, at run sizes that take several merge rounds, and against the SQL."""

import datetime as dt
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arcspan.llm import dominance, queries

BASE = dt.datetime(2024, 3, 10)
SCHEMA = "sale_id long, total double, sold_at timestamp_ntz, level string, run int"


def expected(rows):
    placed = []
    for key, total, at in rows:
        slot = None if at is None else (at - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
        level = None if total is None or not math.isfinite(total) or abs(total) > 8e16 else math.floor(math.floor(100 * total + 0.5) / 100)
        placed.append((key, slot, level, 1 if key is None else 1 + zlib.crc32(str(key).encode()) % 2))
    out = []
    for key, slot, level, _ in placed:
        if slot is None or level is None:
            out.append((key, slot, level, None, None))
            continue
        above = [w for _, s, lv, w in placed if s is not None and lv is not None and s <= slot and lv > level]
        out.append((key, slot, level, len(above), sum(above)))
    return sorted(out, key=repr)


def made(n, seed):
    """Hot slots and levels, ties, repeated rows, nulls, amounts that are no levels, times before 1970."""
    r, rows = random.Random(seed), []
    for i in range(n):
        at = BASE + dt.timedelta(seconds=r.choice([0, 0, r.randrange(40 * 3600)]))
        total = r.choice([50.0, 49.995, r.randrange(3000) / 100, -0.004, -3.2])
        rows.append((i, total, at))
    rows += [(n, None, BASE), (n + 1, 7.0, None), (None, 12.0, BASE), (None, 60.0, BASE), (3, 55.5, BASE), (3, 55.5, BASE), (n + 2, None, None)]
    rows += [(n + 3, math.nan, BASE), (n + 4, math.inf, BASE), (n + 5, 1e300, BASE), (n + 6, 70.0, dt.datetime(1969, 12, 31, 23, 59, 59, 5)), (-5, 99.0, dt.datetime(1969, 12, 31, 22))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_rows, fan", [(1 << 19, 32), (12, 2), (9, 3)])
def test_brute_force(spark, run_rows, fan):
    rows = made(220, run_rows)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    got = dominance.dominated(df, "sale_id", "sold_at", "total", run_rows, fan)
    assert got.columns == ["sale_id", "slot", "level", "n_above", "w_above"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == expected(rows)


def test_one_slot_or_level_holds_all(spark):
    for rows in ([(i, float(i % 37), BASE) for i in range(150)], [(i, 5.0, BASE + dt.timedelta(hours=i % 11)) for i in range(150)]):
        got = dominance.dominated(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA), "sale_id", "sold_at", "total", 10, 2)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == expected(rows)


def test_empty(spark):
    got = dominance.dominated(spark.createDataFrame([], SCHEMA), "sale_id", "sold_at", "total")
    assert got.collect() == []


def test_slot_in_any_zone(spark):
    rows = [(i, 1.0, dt.datetime(2024, 3, 10) + dt.timedelta(minutes=20 * i)) for i in range(30)]
    rows.append((99, 1.0, dt.datetime(1969, 12, 31, 23, 59, 59, 500000)))
    want = sorted((at - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1) for _, _, at in rows)
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    zoned = df.withColumn("sold_at", F.expr("to_timestamp(concat(cast(sold_at as string), 'Z'))"))
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for x in (df, zoned):
                assert sorted(r[0] for r in x.select(dominance.slot(x, "sold_at")).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_merges_in_memory():
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 64, 200):
        levels, weights = r.integers(0, 15, n), r.integers(0, 9, (2, n))
        want = [[sum(weights[k, j] for j in range(i) if levels[j] > levels[i]) for i in range(n)] for k in (0, 1)]
        for fan in (2, 3, 8):
            assert dominance.credit_within(levels, weights, fan).tolist() == want


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sales AS SELECT * FROM '{sf}/sales.parquet'")
    want = con.execute(queries.ORACLE["op11_dominance"])
    columns = [c[0] for c in want.description]
    got = queries.op11_dominance(spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
