"""The listing by ranges, the feed of changes, and what counts as a changed file."""

import hashlib
import os
import time

from pyspark.sql import functions as F

from framelake.operators import state
from framelake.sources import files


def test_large_files_are_hashed_by_their_ends(spark, tmp_path):
    big = tmp_path / "in" / "deep" / "film.MOV"
    big.parent.mkdir(parents=True)
    with open(big, "wb") as f:
        f.write(b"head" * 20_000)
        f.truncate(3 << 30)  # a hole
        f.seek(0, 2)
        f.write(b"tail")
    (tmp_path / "in" / "small.mp3").write_bytes(b"x" * 100_000)
    (tmp_path / "in" / "a.jpg").write_bytes(b"y" * 3_000_000)
    (tmp_path / "in" / ".hidden").mkdir()
    (tmp_path / "in" / ".hidden" / "b.jpg").write_bytes(b"z")
    (tmp_path / "in" / "node_modules").mkdir()
    (tmp_path / "in" / "node_modules" / "c.jpg").write_bytes(b"z")
    (tmp_path / "in" / "empty.wav").write_bytes(b"")
    got = {r.file_name: r for r in files.listing(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"film.MOV", "small.mp3", "a.jpg", "empty.wav"}
    assert got["film.MOV"].file_size == (3 << 30) + 4 and got["film.MOV"].bytes_read == 2 * files.EDGE
    head, tail = (b"head" * 20_000)[: files.EDGE], b"\0" * (files.EDGE - 4) + b"tail"
    assert got["film.MOV"].file_hash == hashlib.sha256(f"v1|{(3 << 30) + 4}|{got['film.MOV'].mtime}|".encode() + head + tail).hexdigest()
    # the ends would overlap: the head alone counts
    assert got["small.mp3"].bytes_read == files.EDGE and got["empty.wav"].bytes_read == 0
    assert got["a.jpg"].file_hash == hashlib.sha256(b"y" * 3_000_000).hexdigest() and got["a.jpg"].kind == "image"
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_many_files_are_dealt_to_splits(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.png").write_bytes(str(i).encode())
    df = files.listing(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.select("file_hash").distinct().count() == 600


def follow(spark, folder, where, until):
    """Events, batch by batch, until ``until`` of them have come."""
    seen = []

    def take(batch, number):
        seen.append(sorted((r.event, os.path.basename(r.file_path), r.file_size) for r in batch.collect()))

    q = files.changes(spark, str(folder), str(where / "state"), settle=0.3).writeStream.foreachBatch(take).option("checkpointLocation", str(where / "check")).trigger(processingTime="200 milliseconds").start()
    yield seen, q
    end = time.time() + 60
    while sum(map(len, seen)) < until and time.time() < end:
        time.sleep(0.1)
    q.processAllAvailable()
    q.stop()
    yield [e for b in seen for e in b], None


def test_each_change_comes_once_also_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"1")
    (folder / "b.mp4").write_bytes(b"22")
    (folder / "c.txt").write_bytes(b"no medium")
    run = follow(spark, folder, tmp_path, 2)
    next(run)
    assert next(run)[0] == [("add", "a.jpg", 1), ("add", "b.mp4", 2)]
    # while nobody looks: an edit that keeps the size, a removal, an addition
    (folder / "a.jpg").write_bytes(b"9")
    os.utime(folder / "a.jpg", (1, 1))
    (folder / "b.mp4").unlink()
    (folder / "d.png").write_bytes(b"4444")
    run = follow(spark, folder, tmp_path, 3)
    next(run)
    assert next(run)[0] == [("add", "d.png", 4), ("change", "a.jpg", 1), ("unlink", "b.mp4", 2)]
    run = follow(spark, folder, tmp_path, 0)
    next(run)
    assert next(run)[0] == []
    assert len(list((tmp_path / "state").glob("*.json"))) <= 2


def test_a_file_being_written_waits(tmp_path, monkeypatch):
    looks = iter([[("/x/a.jpg", 1, 1), ("/x/b.jpg", 5, 5)], [("/x/a.jpg", 2, 2), ("/x/b.jpg", 5, 5)], [("/x/a.jpg", 2, 2)], [("/x/a.jpg", 2, 2)]])
    monkeypatch.setattr(files, "look", lambda folder: next(looks))
    reader = files.MediaChangesReader("/x", str(tmp_path), 0.0)
    one = reader.latestOffset()
    assert [r[:2] for p in reader.partitions(reader.initialOffset(), one) for r in reader.read(p)] == [("add", "/x/b.jpg")]
    two = reader.latestOffset()
    assert [r[:2] for p in reader.partitions(one, two) for r in reader.read(p)] == [("add", "/x/a.jpg"), ("unlink", "/x/b.jpg")]
    # a repeated batch gives the same events; a committed one needs its end only
    assert [r[:2] for p in reader.partitions(one, two) for r in reader.read(p)] == [("add", "/x/a.jpg"), ("unlink", "/x/b.jpg")]
    reader.commit(two)
    assert reader._numbers() == [2]


def test_an_edit_of_equal_size_is_a_change(spark):
    schema = "id long, file_path string, file_size long, mtime long, folder_id long, file_hash string, deleted boolean"
    media = spark.createDataFrame([(1, "same", 5, 100, 1, "h1", False), (2, "newer", 5, 100, 1, "h2", False), (3, "moved", 5, 100, 1, "h3", False), (4, "gone", 5, 100, 1, "h4", True), (5, "nohash", 5, 100, 1, None, False), (6, "nofolder", 5, 100, None, "h6", False)], schema)
    listing = spark.createDataFrame([("same", 5, 100, 1), ("newer", 5, 101, 1), ("moved", 5, 100, 2), ("gone", 5, 100, 1), ("nohash", 5, 100, 1), ("new", 1, 1, 1), ("nofolder", 5, 100, None)], "file_path string, file_size long, mtime long, folder_id long")
    changed = lambda *more: {r.file_path for r in state.changed_files(media, listing, *more).collect()}
    assert changed() == {"newer", "moved", "gone", "nohash", "new"}
    none = spark.createDataFrame([], "file_hash string")
    tasks = lambda *rows: spark.createDataFrame([*rows, (9, "ocr", "pending")], "subject_id long, task_type string, status string")
    assert {"same", "nofolder"} <= changed(none, tasks((1, "thumbnail", "done")))
    assert "same" not in changed(none, tasks((1, "thumbnail", "error"))) and "same" not in changed(spark.createDataFrame([("h1",)], "file_hash string"), tasks())
