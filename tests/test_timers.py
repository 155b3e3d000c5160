"""Batches and progress by the clock, rank search, sketches."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from framelake.operators import doctor, search
from framelake.streaming import ingest

SCHEMA = "id long, ts timestamp, task_type string, value double"


def feed(spark, tmp_path, make, groups, wait):
    """Rows of a stateful stream over groups of rows that are written one after the other; ``wait`` of them are waited for."""
    path, old = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t, seen = datetime.datetime(2024, 1, 1), []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame([], SCHEMA).write.parquet(path)
        stream = make(spark.readStream.schema(SCHEMA).parquet(path))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
        end, put = time.time() + 60, 0
        for rows in groups:
            put += len(rows)
            spark.createDataFrame([(i, t + datetime.timedelta(seconds=i), k, float(i)) for i, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
            # a query with timers by the clock always has another batch, so processAllAvailable() never returns
            while sum(p["numInputRows"] for p in q.recentProgress) < put and time.time() < end:
                time.sleep(0.1)
        while len(seen) < wait and time.time() < end:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return seen


def test_a_batch_closes_by_size_or_when_idle(spark, tmp_path):
    groups = [[(i, "ocr") for i in range(23)] + [(100, "face")], [(i, "ocr") for i in range(23, 30)]]
    got = [(r.task_type, r.n, r.first_id, r.closed_by) for r in feed(spark, tmp_path, lambda s: ingest.batches(s, 10, 30_000), groups, 3)]
    assert sorted(got) == [("ocr", 10, 0, "size"), ("ocr", 10, 10, "size"), ("ocr", 10, 20, "size")]
    got = [(r.task_type, r.n, r.first_id, r.closed_by) for r in feed(spark, tmp_path / "2", lambda s: ingest.batches(s, 10, 500), [[(i, "ocr") for i in range(13)], ], 2)]
    assert sorted(got) == [("ocr", 3, 10, "idle"), ("ocr", 10, 0, "size")]


def test_the_last_progress_always_comes(spark, tmp_path):
    got = [(r.task_type, r.id) for r in feed(spark, tmp_path, lambda s: ingest.progress(s, 4000), [[(1, "embed"), (2, "embed")], [(3, "embed")], [(5, "embed"), (4, "embed")]], 2)]
    assert got[0] == ("embed", 2) and got[-1] == ("embed", 5) and len(got) <= 3


def test_closed_batches_of_a_table(spark):
    t = datetime.datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 4, 8, 9, 20]
    rows = spark.createDataFrame([(i, t + datetime.timedelta(seconds=s), "ocr") for i, s in enumerate(times)], "id long, ts timestamp, task_type string")
    assert sorted((r.first_id, r.n) for r in ingest.closed_batches(rows, 2).collect()) == [(0, 2), (2, 2), (4, 1), (5, 2), (7, 1)]


@pytest.mark.parametrize("few", [4, 1000])
def test_ranks_are_exact_and_no_window_is_large(spark, few):
    rng = random.Random(2)
    values = {"hot": [rng.lognormvariate(0, 4) for _ in range(3000)], "one": [7.5] * 50, "few": [1.0, 2.0], "far": [-1e300, 0.0, 1e-300, 5e-301, 1e300], None: [3.0, 1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double").repartition(4)
    got = {r.k: (r.n, r.p50, r.p95, r.max) for r in doctor.percentiles(df, ["k"], "v", few).collect()}
    rank = lambda s, p: s[min(len(s) - 1, int(len(s) * p))]
    assert got == {k: (len(v), rank(sorted(v), 0.5), rank(sorted(v), 0.95), max(v)) for k, v in values.items()}
    assert doctor.percentiles(df.limit(0), ["k"], "v").count() == 0


def test_merged_sketches_are_the_sketch_of_all(spark):
    v = spark.range(1000).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    a, b, whole = (search.sketch(df, "id") for df in (v.where("id < 900"), v.where("id >= 900"), v))
    rows = lambda df: sorted((r.sample_id, r.n) for r in df.collect())
    assert rows(search.merged_sketches(a, b)) == rows(whole) and len(rows(whole)) == search.SAMPLE
    # the same rows as the search's own sample
    assert {r[0] for r in rows(whole)} == {str(r.sample_id) for r in search.baseline(v, "id").collect()}
    assert not search.stale(100, 110) and search.stale(100, 111) and not search.stale(1000, 1100) and search.stale(5, 16)
