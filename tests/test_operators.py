"""Semantics that the driver's tables don't show: nulls, ties, thresholds, order."""

import datetime
import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import media as M
from framelake.functions import text as T
from framelake.functions import vector as X
from framelake.operators import browse, doctor, people, queue, search, state, textsearch, vectors
from framelake.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(v):
    return F.lit(v)


def vec(v):
    return F.lit([float(x) for x in v]).cast("array<float>")


# ---- vectors


def test_vector_functions(spark):
    assert one(spark, X.dot(vec([1, 2, 3]), vec([4, 5]))) == 14
    assert one(spark, X.l2(vec([0, 0]), vec([3, 4]))) == 5
    assert one(spark, X.normalise(vec([0, 0]))) == [0, 0]
    assert one(spark, X.normalise(vec([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, X.l2_to_cosine(X.l2(vec([1, 0]), vec([0, 1])))) == pytest.approx(0)
    assert one(spark, X.pair_key(lit(9), lit(3))) == "3:9"


def test_batch_nearest_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[5] = m[6] = m[7]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in vectors.batch_nearest(spark, df, df.where("vec_id < 10"), 4).collect()}
    m = m.astype(np.float32).astype(float)
    for q in range(10):
        cos = m @ m[q]
        cos[q] = -9
        want = sorted(range(300), key=lambda i: (-cos[i], i))[:4]
        assert [got[q, r] for r in range(4)] == want
    assert vectors.batch_nearest(spark, df, df.limit(0), 4).count() == 0


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "g long, embedding array<float>")
    got = {r.g: r.centroid for r in vectors.centroids(df, "g").collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2)
    assert got[2] == [0, 0]


# ---- catalogue


def media(spark, rows):
    return spark.createDataFrame(rows, "id long, file_hash string, folder_id long, taken_at string, kind string, deleted boolean, file_name string, file_path string, file_size long, video_id long, created_at timestamp_ntz, lat double, lng double")


def item(id, hash="h", folder=1, taken=None, kind="image", deleted=False, name=None, size=1, video=None):
    return (id, hash, folder, taken, kind, deleted, name or f"f{id}.jpg", f"/a/{name or f'f{id}.jpg'}", size, video, datetime.datetime(2024, 1, 1, 0, id), 1.0, 1.0)


def test_representatives(spark):
    m = media(spark, [item(1, deleted=True), item(2), item(3), item(4, None), item(5, "x")])
    got = {r.file_hash: (r.id, r.copies) for r in browse.representatives(m).collect()}
    assert got == {"h": (2, 2), "x": (5, 1)}  # a null hash has none


def test_folder_filter_looks_at_all_copies(spark):
    m = media(spark, [item(1, "h", 1), item(2, "h", 2)])
    assert [r.id for r in browse.filtered(m, folder_id=2).collect()] == [1]


def test_date_filter_is_textual(spark):
    m = media(spark, [item(1, "a", taken="2024-12-31T10:00:00.000Z"), item(2, "b"), item(3, "c", taken="2024-12-30T10:00:00.000Z")])
    assert {r.id for r in browse.filtered(m, date_to="2024-12-31").collect()} == {3}
    assert {r.id for r in browse.filtered(m, date_to="2024-12-31", null_dates="keep").collect()} == {2, 3}


def test_file_name_search_escapes(spark):
    m = media(spark, [item(1, "a", name="100%.JPG"), item(2, "b", name="1000.jpg"), item(3, "c", name="a_b!.jpg"), item(4, "d", name="axb.jpg")])
    find = lambda q: [r.file_hash for r in textsearch.by_file_name(m, q, 9).collect()]
    assert find("100%") == ["a"]
    assert find("A_B") == ["c"]
    assert find("b!") == ["c"]


def test_upsert_and_partial_update(spark):
    old = spark.createDataFrame([(1, "a", 5, "p"), (2, "b", 6, "q")], "id long, name string, size long, person string")
    new = spark.createDataFrame([(2, None, None, "z"), (3, "c", 7, "y")], "id long, name string, size long, person string")
    got = {r.id: (r.name, r["size"], r.person) for r in state.upsert(old, new, ["id"], keep_if_null=("size",), keep=("person",)).collect()}
    assert got == {1: ("a", 5, "p"), 2: (None, 6, "q"), 3: ("c", 7, "y")}


def test_cascades(spark):
    m = media(spark, [item(1, "a", 1), item(2, "a", 2), item(3, "b", 1), item(4, "c", 2, video=7)])
    assert {r.file_hash for r in state.orphans(m, 1).collect()} == {"b"}
    tasks = spark.createDataFrame([(1, 1, "embed"), (2, 1, "extract_frames"), (3, 2, "embed")], "id long, subject_id long, task_type string")
    left, kept, gone = state.folder_removed(m, tasks, 1)
    assert left.count() == 2 and {r.id for r in kept.collect()} == {2, 3} and gone.count() == 1
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "file_hash string")
    assert {r.file_hash for r in state.collected(v, state.video_removed(m, 7)).collect()} == {"a", "b"}


# ---- queue


def test_null_subjects_exclude_nothing(spark):
    v = media(spark, [item(1, kind="video"), item(2, kind="video")]).withColumn("duration_ms", F.lit(5))
    t = spark.createDataFrame([(1, None, "extract_frames", "pending"), (2, 2, "extract_frames", "pending")], "id long, subject_id long, task_type string, status string")
    s = spark.createDataFrame([], "video_id long")
    assert [r.id for r in queue.unscanned_videos(v, s, t).collect()] == [1]


def test_queue_on_empty_input(spark):
    t = spark.createDataFrame([], "id long, task_type string, status string")
    assert queue.stats(t).first() == (0, 0, 0, 0)


def test_colliding_subject_ids(spark):
    p = media(spark, [item(7, name="p.jpg")])
    v = media(spark, [item(7, name="v.mp4", kind="video")])
    t = spark.createDataFrame([(1, 7, "embed", "pending", 10, None), (2, 7, "extract_frames", "processing", 6, None), (3, 8, "extract_frames", "pending", 6, None)], "id long, subject_id long, task_type string, status string, priority long, error_msg string")
    got = [(r.id, r.name, r.kind) for r in queue.rows(t, p, v, ["pending", "processing"], 9).orderBy("id").collect()]
    assert got == [(1, "p.jpg", "image"), (2, "v.mp4", "video"), (3, "", "video")]


def test_pruning_and_recovery(spark):
    t = spark.createDataFrame([(i, "embed", "done" if i < 4 else "processing", None) for i in range(1, 6)], "id long, task_type string, status string, error_msg string")
    assert {r.id for r in queue.pruned(t, 1).collect()} == {3, 4, 5}
    assert queue.recovered(t).where("status = 'pending'").count() == 2


# ---- text


@pytest.mark.parametrize(
    "raw,want",
    [("", ""), ("   ", ""), ("cat", '"cat"'), ("iPhone 15", '"iPhone" OR "15"'), ('foo"bar (baz) -qux', '"foobar" OR "baz" OR "qux"'), ("cat NEAR dog and fish", '"cat" OR "dog" OR "fish"'), ("---", "")],
)
def test_fts_query(spark, raw, want):
    assert one(spark, T.fts_query(lit(raw))) == want


def test_segmentation_of_cjk(spark):
    assert one(spark, T.segmented(lit("  a   b "))) == "a b"
    assert one(spark, T.segmented(lit("黄色跑车"))).split() == ["黄色", "色跑", "跑车"]


def test_formats(spark):
    assert [one(spark, T.duration_text(lit(x))) for x in (0, 59_999, 61_000, 3_600_000, 3_661_000)] == ["0:00", "0:59", "1:01", "1:00:00", "1:01:01"]
    assert [one(spark, T.size_text(lit(x))) for x in (0, 1, 1536, 1048576)] == ["0 B", "1 B", "1.5 KB", "1 MB"]
    assert [one(spark, T.span_text(lit(x))) for x in (10, 90_000, 5_400_000)] == ["1 s", "2 min", "1.5 h"]
    assert one(spark, T.parsed_duration(lit("  Duration: 00:01:02.50, start"))) == 62_500
    assert one(spark, T.parsed_duration(lit("no"))) is None
    assert one(spark, T.parsed_size(lit("Stream #0:0: Video: h264 (x / 0x31637668), 1920x1080, rotation of 90"))) == (1080, 1920)
    assert one(spark, T.base_name(lit("/a/b/"))) == "/a/b/"
    assert one(spark, T.prefixed(lit(" task: x"))) == "task: x" and one(spark, T.prefixed(lit("x "))) == "task: search query | text: x"
    assert one(spark, T.parsed_duration(lit("Duration: 00:00:00.00"))) is None
    assert [one(spark, browse.rank_for_zoom(lit(z))) for z in (1, 3, 4, 5, 6, 7)] == [-1, 1, 2, 3, 4, 99]


@pytest.mark.parametrize(
    "header,size,want",
    [(None, 9, (200, None, None)), ("bytes=0-3", 9, (206, 0, 3)), ("bytes=5-", 9, (206, 5, 8)), ("bytes=-4", 9, (206, 5, 8)), ("bytes=-0", 9, (416, None, None)), ("bytes=9-", 9, (416, None, None)), ("bytes=4-2", 9, (416, None, None)), ("bytes=0-1,3-4", 9, (200, None, None)), ("bytes=x", 9, (416, None, None)), ("items=1-2", 9, (200, None, None)), ("bytes=-5", 0, (416, None, None))],
)
def test_byte_range(spark, header, size, want):
    assert tuple(one(spark, M.byte_range(lit(header).cast("string"), lit(size).cast("long")))) == want


@pytest.mark.parametrize("name,kind", [("a.JPG", "image"), ("b.cr3", "image"), ("c.MoV", "video"), ("d.opus", "audio"), (".hidden", None), ("none", None), ("x.txt", None)])
def test_kinds(spark, name, kind):
    assert one(spark, M.kind_of(lit("/p/" + name))) == kind


def test_bm25_idf_floor_and_empty_text(spark):
    texts = spark.createDataFrame([("a", "cat dog"), ("b", "cat"), ("c", "cat fish"), ("d", ""), ("e", None)], "file_hash string, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "dog cat"), (3, "!!")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): r.file_hash for r in textsearch.bm25(texts, q, 9).collect()}
    assert got[2, 0] == "a" and (3, 0) not in got and len([k for k in got if k[0] == 1]) == 3


# ---- fusion and search


def ranked(spark, channels):
    rows = [(c, h, r) for c, items in enumerate(channels) for r, h in enumerate(items)]
    return spark.createDataFrame(rows or [(0, None, 0)], "channel int, file_hash string, rank int").where("file_hash is not null")


def fused(spark, channels, k=60):
    rows = search.rrf(ranked(spark, channels), k=k).orderBy(*search.fusion_order()).collect()
    return [(r.file_hash, r.score) for r in rows]


def test_rrf(spark):
    assert fused(spark, []) == []
    assert [h for h, _ in fused(spark, [["a", "b", "c"]])] == ["a", "b", "c"]
    assert [h for h, _ in fused(spark, [["a", "b"], ["c", "b"]])][0] == "b"
    assert dict(fused(spark, [["a"]]))["a"] == pytest.approx(1 / 61)
    assert dict(fused(spark, [["a", "x", "a"]]))["a"] == pytest.approx(1 / 61 + 1 / 63)
    assert [h for h, _ in fused(spark, [["b"], ["a"]])] == ["b", "a"]  # ties by channel


@pytest.mark.parametrize("n", [0, 19, 20, 149, 150])
def test_gate(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x), 0.0]) for i, x in enumerate(rng.normal(0, 0.1, n))]
    sample = spark.createDataFrame(rows, "sample_id long, embedding array<float>")
    hits = spark.createDataFrame([(1, 0.9), (2, 0.05)], "id int, cosine double")
    got = {r.id: r.passed for r in search.gated(hits, sample, [1.0, 0.0]).collect()}
    assert got[1] and got[2] == (n < 20)


def test_gate_statistics(spark):
    sample = spark.createDataFrame([(i, [float(i)]) for i in (1, 2, 3, 4)], "sample_id long, embedding array<float>")
    r = search.gate_stats(sample, [1.0]).first()
    assert (r.n, r["mean"], r["median"], r["mad"]) == (4, 2.5, 3.0, 1.0)  # upper medians
    flat = spark.createDataFrame([(i, [0.5]) for i in range(30)], "sample_id long, embedding array<float>")
    hits = spark.createDataFrame([(1, 0.5), (2, 0.51)], "id int, cosine double")
    assert {r.id: r.passed for r in search.gated(hits, flat, [1.0]).collect()} == {1: False, 2: True}


def small_library(spark, n=40):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(n, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [item(i, f"h{i:02}", 1 + i % 2, kind="video" if i % 10 == 0 else "image", video=i // 10 if i % 10 == 0 else None) for i in range(n)]
    v = spark.createDataFrame([(f"h{i:02}", r.tolist()) for i, r in enumerate(m)], "file_hash string, embedding array<float>")
    s = spark.createDataFrame([(i, i % 4, 32_000 * i, 32_000 * i + 32_000, r.tolist()) for i, r in enumerate(-m)], "segment_id long, video_id long, start_ms long, end_ms long, embedding array<float>")
    t = spark.createDataFrame([(f"h{i:02}", f"word{i} common") for i in range(n)], "file_hash string, text string")
    return search.Library(media(spark, rows), v, s, t), m


def test_search_finds_by_every_channel(spark):
    lib, m = small_library(spark)
    got = search.search(lib, search.Query("word7", m[7].tolist(), 10)).orderBy("rank").collect()
    assert got[0].file_hash == "h07" and got[0].matched_by.split(",")[0] == "visual" and "text" in got[0].matched_by and got[0].score == 1.0
    assert len({r.file_hash for r in got}) == len(got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert {r.kind for r in search.search(lib, search.Query("common", m[7].tolist(), 10, kind="video")).collect()} <= {"video"}


def test_search_falls_back_with_low_confidence(spark):
    lib, m = small_library(spark)
    q = np.zeros(16)
    q[0] = 1e-9
    got = search.search(lib, search.Query("zzz", q.tolist(), 50)).collect()
    assert got and all(r.low_confidence for r in got) and len(got) <= 12


# ---- people


def identity(seed, d=64):
    s, out = seed, []
    for _ in range(d):
        s = (s * 1664525 + 1013904223) % 2**32
        out.append(s / 2**31 - 1)
    v = np.array(out)
    return v / np.linalg.norm(v)


def sample(base, seed, noise=0.8):
    v = base + identity(seed * 7919) * noise
    return v / np.linalg.norm(v)


A, B, C = identity(11), identity(22), identity(33)


def plan(pending, dormant=(), persons=(), rejected=None, dismissed=()):
    return people.plan_clusters(pending, [(*f, 0.3)[:3] for f in dormant], list(persons), rejected or {}, set(dismissed))


def test_clustering_groups_identities():
    faces = [(10 * g + i, sample(b, 10 * g + i + 1), 0.9) for g, b in enumerate((A, B, C)) for i in range(4)]
    got = plan(faces)
    assert sorted(sorted(c) for c in got["create"]) == [[0, 1, 2, 3], [10, 11, 12, 13], [20, 21, 22, 23]]
    assert not got["assign"] and not got["dormant"]


def test_clustering_assigns_and_keeps_singles_dormant():
    got = plan([(1, sample(A, 1), 0.9), (2, sample(B, 2), 0.9)], persons=[(5, True, A, 10)])
    assert got["assign"] == [(1, 5)] and got["dormant"] == [2]


def test_poor_faces_never_seed_and_dormant_ones_are_called():
    assert plan([(1, sample(A, 1), 0.2), (2, sample(A, 2), 0.2)])["create"] == []
    got = plan([(1, A, 0.9)], dormant=[(2, sample(A, 2, 0.3))])
    assert sorted(got["create"][0]) == [1, 2]


def test_rejections_and_merges():
    assert plan([(1, sample(A, 1), 0.9)], persons=[(5, True, A, 10)], rejected={1: {5}})["assign"] == []
    near = sample(A, 4, 0.2)
    pair = [(5, True, A, 10), (6, False, near, 3)]
    assert plan([(1, A, 0.9)], persons=pair)["merges"] == [(6, 5)]
    assert plan([(1, A, 0.9)], persons=pair, dismissed={(5, 6)})["merges"] == []
    assert plan([(1, A, 0.9)], persons=[(5, True, A, 10), (6, True, near, 3)])["merges"] == []


def test_plan_covers_the_pending_set():
    faces = [(i, sample(identity(100 + i % 5), i + 1, 1.2), (i % 10) / 10) for i in range(60)]
    got = plan(faces)
    seen = [f for f, _ in got["assign"]] + [f for c in got["create"] for f in c] + got["dormant"]
    assert sorted(seen) == list(range(60))


# ---- media


def test_segments(spark):
    for ms, n in ((0, 1), (1, 1), (31_999, 1), (32_000, 1), (32_001, 2)):
        got = one(spark, M.segments(lit(ms).cast("long")))
        assert len(got) == n and got[-1].end_ms == ms


def test_wav(spark):
    raw = bytes(one(spark, M.wav_pack(vec([0, 2, -2, 0.5]))))
    with wave.open(io.BytesIO(raw)) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth()) == (1, 16_000, 2)
        assert np.frombuffer(w.readframes(9), "<i2").tolist() == [0, 32767, -32767, 16384]
    assert len(raw) == 44 + 8


def test_nms_and_iou(spark):
    rows = [("i", 0.0, 0.0, 1.0, 1.0, 0.9), ("i", 0.1, 0.0, 1.0, 1.0, 0.8), ("i", 3.0, 3.0, 1.0, 1.0, 0.1), ("j", 0.1, 0.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "image string, x double, y double, w double, h double, confidence double")
    assert sorted(r.confidence for r in M.suppressed(df, "image").collect()) == [0.1, 0.5, 0.9]


def test_ctc(spark):
    eye = np.eye(4) * 0.96 + 0.01
    rows = [("l", i, eye[c].tolist()) for i, c in enumerate([1, 1, 0, 1, 2, 0, 0, 3])]
    got = M.ctc_decode(spark.createDataFrame(rows, "line string, step int, probs array<double>"), "line", ["a", "b", "c"]).first()
    assert got.text == "aabc" and got.score == pytest.approx(0.97)


def test_boxes_and_sharpness():
    p = np.zeros((40, 40))
    p[5:15, 5:25] = 0.9
    p[30:32, 30:32] = 0.9
    (x, y, w, h, s), = M.text_boxes(p)
    assert x < 5 and y < 5 and w > 20 and h > 10 and s == pytest.approx(0.9)
    board = np.indices((112, 112)).sum(axis=0) % 2 * 255
    assert M.laplacian_variance(np.full((112, 112), 9)) == 0 and M.laplacian_variance(board) > 1000


def test_similarity_fit_recovers_a_transform(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(5, 2))
    q = np.stack([1.5 * p[:, 0] - 0.5 * p[:, 1] + 2, 0.5 * p[:, 0] + 1.5 * p[:, 1] - 1], axis=1)
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(p, q)], "k int, sx double, sy double, dx double, dy double")
    assert list(M.similarity_fit(df, ["k"]).first())[1:] == pytest.approx([1.5, 0.5, 2, -1])


# ---- health and sources


def test_percentiles_and_backups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0)], "k string, v double")
    got = {r.k: (r.p50, r.p95, r["max"]) for r in doctor.percentiles(df, ["k"], "v").collect()}
    assert got == {"a": (11.0, 20.0, 20.0), "b": (5.0, 5.0, 5.0)}
    names = spark.createDataFrame([(f"library.db.bak.2024010{i}T000000Z",) for i in range(1, 6)] + [("other",)], "name string")
    assert doctor.expired_backups(names, 0).count() == 4 and doctor.expired_backups(names, 3).count() == 2


def test_basemap(spark):
    rows = [("a", 3, 0, False, [(1.00011, 2.0), (1.00012, 2.0), (1.5, 2.0)]), ("b", 9, 5, False, []), ("c", 9, 5, True, [(0.0, 0.0)])]
    df = spark.createDataFrame(rows, "name string, scalerank int, pop long, capital boolean, ring array<struct<lng:double,lat:double>>")
    got = {r.name: len(r.ring) for r in tables.basemap(df).collect()}
    assert got == {"a": 2, "c": 1}


def test_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.JPG").write_bytes(b"1")
    (tmp_path / "x" / "b.txt").write_bytes(b"2")
    got = tables.listing(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.kind, r.file_size) for r in got] == [("a.JPG", "image", 1)]


# ---- order-dependent steps, edits


def test_reading_order(spark):
    from framelake.functions import sequence as S

    rows = [("i", 50.0, 3.0, 9.0, 4.0, "b", 0.9), ("i", 1.0, 5.0, 9.0, 4.0, " a ", 0.9), ("i", 0.0, 40.0, 9.0, 4.0, "c", 0.6), ("i", 0.0, 60.0, 9.0, 4.0, "bad", 0.4), ("i", 0.0, 80.0, 9.0, 4.0, " ", 0.9)]
    df = spark.createDataFrame(rows, "image string, x double, y double, w double, h double, text string, score double")
    assert S.lines_text(df, "image").first().text == "a\nb\nc"


def test_reading_order_of_ties_does_not_follow_arrival(spark):
    from framelake.functions import sequence as S

    rows = [("i", 1.0, 5.0, 1.0, 4.0, t, 0.9) for t in "dbca"] + [("i", 1.0, 3.0, 1.0, 4.0, "z", 0.9)]
    read = lambda some: S.lines_text(spark.createDataFrame(some, "image string, x double, y double, w double, h double, text string, score double").coalesce(1), "image").first().text
    assert read(rows) == read(rows[::-1]) == "z\na\nb\nc\nd"


def test_history_and_forward_fill(spark):
    from framelake.functions import sequence as S

    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["c", "ca", "cat", "dog", "do", " ", "dog  x", None])], "k int, o int, t string")
    assert [r.t for r in S.collapsed_history(df.where("t is not null"), "k", "o", "t").orderBy("o").collect()] == ["cat", "dog x"]
    assert [r.t for r in S.forward_filled(df, "k", "o", "t").orderBy("o").collect()][-1] == "dog  x"


def test_people_edits(spark):
    people_ = spark.createDataFrame([(1, "a", False), (2, "b", False)], "person_id long, name string, hidden boolean")
    names = spark.createDataFrame([(1, " ")], "person_id long, new_name string")
    assert {r.person_id: r.name for r in people.renamed(people_, names).collect()} == {1: None, 2: "b"}
    assert {r.person_id: r.hidden for r in people.hidden(people_, names).collect()} == {1: True, 2: False}
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert people.dismiss(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).count() == 1
    r = spark.createDataFrame([(7, 1), (7, 2)], "face_id long, person_id long")
    moved, left = people.moved_constraints(r, pairs, 1, 2)
    assert [tuple(x) for x in moved.collect()] == [(7, 2)] and left.count() == 0


def test_plan_application_skips_assigned_faces(spark):
    faces = spark.createDataFrame([(1, None), (2, 5), (3, None)], "face_id long, person_id long")
    plan_ = spark.createDataFrame([(1, "assign", 4), (2, "assign", 4), (3, "dormant", -1)], "face_id long, action string, target long")
    got = {r.face_id: (r.person_id, r.dormant) for r in people.apply_plan(faces, plan_).collect()}
    assert got == {1: (4, False), 2: (5, False), 3: (None, True)}


def test_moved_centroid(spark):
    c = one(spark, vectors.moved(vec([1, 0]), lit(1), vec([0, 1])))
    assert c == pytest.approx([0.5**0.5] * 2)


def test_pose(spark):
    from framelake.functions import sequence as S

    f = lambda *v: one(spark, S.yaw(*[lit(float(x)) for x in v]))
    assert f(0, 2, 1, 0, 0, 1) == 0 and f(0, 2, 2, 0, 0, 1) == 0.5 and f(1, 1, 1, 1, 1, 1) == 0


def test_doctor_sees_plans(spark):
    a, b = spark.range(3), spark.range(3).withColumnRenamed("id", "j")
    assert "nested loop join" in doctor.plan_warnings(a.join(b, a.id < b.j)) or "cartesian product" in doctor.plan_warnings(a.join(b, a.id < b.j))
    assert doctor.plan_warnings(a.where("id > 1")) == []


def test_one_tokeniser_for_texts_and_queries(spark):
    from framelake.operators.textsearch import bm25

    docs = spark.createDataFrame([("a", "我们今天去图书馆看书"), ("b", "今天天气很好"), ("c", "Die Bücher im Regal"), ("a", "我们今天去图书馆看书"), ("d", None), ("e", "plain words")], "file_hash string, text string")
    asked = spark.createDataFrame([(1, "图书馆"), (2, "天气"), (3, "bucher"), (4, "plain"), (5, "没有")], "query_id int, text string")
    got = {(r.query_id, r.file_hash) for r in bm25(docs, asked, 5).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c"), (4, "e")}


def test_copies_of_a_text_count_once(spark):
    from framelake.operators.textsearch import bm25

    texts = [(f"h{i}", f"red {'blue ' * (i % 4)}tail{i}") for i in range(30)]
    asked = spark.createDataFrame([(1, "blue tail7")], "query_id int, text string")
    rank = lambda rows: [(r.file_hash, round(r.score, 9)) for r in bm25(spark.createDataFrame(rows, "file_hash string, text string"), asked, 50).orderBy("rank").collect()]
    assert rank(texts) == rank(texts + texts[3:9] * 4) and len(rank(texts)) == 22


def test_aligned_square_is_a_bilinear_sample():
    r = np.random.default_rng(2)
    pixels = r.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (M.aligned(pixels, (1, 0, 3, 2), 10) == pixels[2:12, 3:13]).all()
    assert (M.aligned(pixels, (1, 0, 3, 2), 10, mirror=True) == pixels[2:12, 3:13][:, ::-1]).all()
    half = M.aligned(pixels, (1, 0, 3.5, 2), 10)
    assert (half == np.floor((pixels[2:12, 3:13].astype(float) + pixels[2:12, 4:14]) / 2 + 0.5)).all()
    turned = M.aligned(pixels, (0, 1, 15, 3), 6)  # x = 15 - v, y = 3 + u
    assert all((turned[v, u] == pixels[3 + u, 15 - v]).all() for v in range(6) for u in range(6))
    assert not M.aligned(pixels, (1, 0, 500, 0), 8).any()
    edge = M.aligned(pixels, (1, 0, 28.5, 0), 3)  # beyond the last column counts as 0
    assert (edge[:, 1] == np.floor(pixels[:3, 29] / 2 + 0.5)).all() and not edge[:, 2].any()
