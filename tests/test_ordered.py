"""Ordered scans in pieces equal plain loops, also where one key holds all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framelake.operators import ordered

PIECES = 7


def rows_of(keys, n=400, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(keys), r.random() if r.random() < 0.3 else None) for i in range(n)]


@pytest.fixture(params=[["a"], ["a", "a", "a", "a", "b", "c", None]])
def rows(request):
    return rows_of(request.param)


def table(spark, rows):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "o long, k string, v double")


def test_forward_filled(spark, rows):
    want, last = {}, {}
    for o, k, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[o] = last[k]
    got = ordered.forward_filled(table(spark, rows), "k", "o", "v", PIECES)
    assert got.columns == ["o", "k", "v"] and {r.o: r.v for r in got.collect()} == want


@pytest.mark.parametrize("pieces", [PIECES, 150])  # pieces of fewer rows than the mean is over, too
def test_moving_mean(spark, rows, pieces):
    want, seen = {}, {}
    for o, k, v in rows:
        seen.setdefault(k, []).append(v)
        some = [x for x in seen[k][-8:] if x is not None]
        want[o] = sum(some) / len(some) if some else None
    got = {r.o: r.mean_last for r in ordered.moving_mean(table(spark, rows), "k", "o", "v", 8, pieces).collect()}
    assert got == {o: None if m is None else pytest.approx(m) for o, m in want.items()}


def test_lags(spark, rows):
    start = datetime(2024, 1, 1)
    r = random.Random(5)
    ticks, at = [], start
    for o, k, _ in rows:
        at += timedelta(milliseconds=r.choice([0, 500, 1700]))  # ties are told apart by id
        ticks.append((o, k, None if o == 3 else at))
    want, before = {}, {}
    for o, k, t in sorted(ticks, key=lambda x: (x[2] is not None, x[2] or start, x[0])):
        late = None if before.get(k) is None or t is None else (t - before[k]).total_seconds() * 1000 - 1000
        want[o] = 0.0 if late is None else max(0.0, late)
        before[k] = t
    df = spark.createDataFrame(ticks, "id long, k string, t timestamp_ntz")
    got = {r.id: r.lag_ms for r in ordered.lags(df, "k", "t", 1000.0, PIECES).collect()}
    assert got == {o: pytest.approx(x) for o, x in want.items()}


def test_one_key_spans_even_pieces_and_empty_tables(spark):
    df = table(spark, rows_of(["a"], 4000))
    sizes = [r["count"] for r in ordered.in_pieces(df, "k", ["o"], 8).groupBy(ordered.PIECE, "k").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 4000 / 8
    plan = ordered.forward_filled(df, "k", "o", "v", 8)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_piece" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))
    assert ordered.forward_filled(df.limit(0), "k", "o", "v").count() == 0
    assert ordered.moving_mean(df.limit(0), "k", "o", "v").count() == 0
    assert ordered.in_pieces(df.withColumn("o", F.lit(1)), "k", ["o"], 8).count() == 4000
