import datetime

import pytest
from pyspark.sql import functions as F

from framelake.operators import state
from framelake.streaming import ingest


def test_ingest_upserts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"1")
    (tmp_path / "in" / "b.mp3").write_bytes(b"2")
    (tmp_path / "in" / "c.doc").write_bytes(b"3")
    held = {"df": spark.createDataFrame([], "path string, length long, kind string, file_hash string")}

    def apply(batch, number):
        rows = batch.select("path", "length", "kind", "file_hash")
        held["df"] = spark.createDataFrame(state.upsert(held["df"], rows, ["path"]).collect(), held["df"].schema)

    for _ in range(2):  # a restart from the checkpoint brings nothing twice
        ingest.ingest(ingest.watched(spark, str(tmp_path / "in")), apply, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.kind for r in held["df"].collect()) == ["audio", "image"]


def events(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(milliseconds=100 * i), "embed", "done", float(i)) for i in range(6)] + [(9, t + datetime.timedelta(seconds=30), "embed", "done", 9.0)]
    return spark.createDataFrame(rows, "id long, ts timestamp, task_type string, status string, value double")


def test_coalesced_progress_and_idle_batches(spark):
    got = [(r.id, r.n) for r in ingest.coalesced(events(spark)).orderBy("start").collect()]
    assert got == [(2, 3), (4, 2), (5, 1), (9, 1)]
    assert [r.n for r in ingest.idle_batches(events(spark)).orderBy("start").collect()] == [6, 1]


def test_running_centroids(spark, tmp_path):
    path = str(tmp_path / "faces")
    spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "person_id long, embedding array<double>").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("person_id long, embedding array<double>").parquet(path)
    q = ingest.running_centroids(stream).writeStream.outputMode("update").format("memory").queryName("centroids").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.person_id: (r.n, r.centroid) for r in spark.table("centroids").select("person_id", "n", "centroid").collect()}
    assert got[1] == (2, pytest.approx([0.5**0.5] * 2)) and got[2][1] == pytest.approx([0.0, 1.0])


def test_stream_windows_match_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark).write.parquet(path)
    stream = spark.readStream.schema(events(spark).schema).parquet(path)
    q = ingest.windowed(stream, late="1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.n) for r in spark.table("windows").collect()} == {(r.start, r.n) for r in ingest.windowed(events(spark)).select("start", "n", F.lit(0)).collect()}
