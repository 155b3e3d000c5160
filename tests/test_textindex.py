"""Phrases, the maintained index against a rebuild, and versions of several tables."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from framelake import queries as Q
from framelake.operators import search, textsearch
from framelake.sources.versions import Conflict, Versions

WORDS = "red blue green foo bar foobar the salt pepper über élan 3 5mm it's".split()


def texts(spark, rows):
    return spark.createDataFrame([(str(d), t) for d, t in rows], "file_hash string, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")


def found(df):
    return {(r.query_id, r["rank"]): (r.file_hash, round(r.score, 8)) for r in df.collect()}


def random_text(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))


QUERIES = ("red", "it's", "cat AND the", "3.5mm blue", "foo-bar", "foo_bar green.red", "OR NOT ---", "blue blue salt", "élan")


@pytest.mark.parametrize(
    "query,want",
    [
        ("cat AND dog", {"cats"}),  # operator words aren't searched for
        ("foo-bar", {"foobar"}),  # a mark inside is deleted: one word
        ("foo.bar", {"dots"}),  # other punctuation makes a phrase
        ("salt_and_pepper", {"salt"}),
        ('"salt (pepper) -qux', {"salt", "other", "qux"}),
        ("NEAR or not", set()),
        ("---", set()),
        ("", set()),
        ("Élan", {"elan", "composed"}),
        ("a.a.a", {"aaaa"}),
        ("Őszi čaj", {"marks"}),
    ],
)
def test_queries_are_read_as_the_builder_writes_them(spark, query, want):
    rows = [("cats", "my cat"), ("salt", "salt and pepper"), ("other", "pepper, then salt"), ("foobar", "foobar"), ("dots", "so foo bar"), ("apart", "foo the bar; and or near"), ("qux", "qux"), ("elan", "ELAN"), ("composed", "élan"), ("aaaa", "a a a a"), ("marks", "oszi caj")]
    assert {r.file_hash for r in textsearch.bm25(texts(spark, rows), asked(spark, query), 20).collect()} == want


def test_a_phrase_counts_its_places(spark):
    t, q = texts(spark, [("a", "x y x y x"), ("b", "y x y"), ("c", "x x y"), ("d", "a a a a")]), textsearch.phrases(asked(spark, "x.y", "a.a"))
    tf = {(tuple(r.phrase.split()), r.doc): r.tf for r in textsearch.matched(textsearch.postings(t, "file_hash").where("term <> ''"), q.select("phrase").distinct()).collect()}
    assert tf == {(("x", "y"), "a"): 2, (("x", "y"), "b"): 1, (("x", "y"), "c"): 1, (("a", "a"), "d"): 3}


def test_a_changed_index_equals_a_rebuild(spark, tmp_path):
    rng, live = random.Random(4), {}
    index = textsearch.TextIndex(spark, f"file://{tmp_path}/index", buckets=8)
    q = asked(spark, *QUERIES)
    assert index.search(q, 5).count() == 0
    for step in range(5):
        new = {rng.randrange(60): random_text(rng) for _ in range(30 if step < 1 else 12)}
        live |= new
        index.upsert(texts(spark, [x for x in new.items() for _ in range(rng.randrange(1, 3))]))
        if step in (1, 3):
            gone = rng.sample(sorted(live), 6) + [99]
            index.delete(texts(spark, [(g, None) for g in gone]))
            live = {d: t for d, t in live.items() if d not in gone}
        if step in (2, 4):
            before = len(index.segments())
            assert index.merge() and len(index.segments()) < before
        scan = textsearch.bm25(texts(spark, live.items()), q, 50)
        assert found(index.search(q, 50)) == found(scan) and scan.count() > 50
        assert index.sums()[0] == len(live)


def test_merges_keep_few_segments_and_all_documents(spark, tmp_path):
    index = textsearch.TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    for i in range(6):
        index.upsert(texts(spark, [(f"{i}-{j}", f"word{i} all") for j in range(4)]))
        index.merge()
    sizes = [s["docs"] for s in index.segments()]
    assert sum(sizes) == 24 and len(sizes) <= 3 and index.search(asked(spark, "all"), 100).count() == 24


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = textsearch.TextIndex(spark, f"file://{tmp_path}/index", buckets=32)
    rng = random.Random(1)
    index.upsert(texts(spark, [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(200)]))
    every = {f for b in [index._postings(1, index.segments(), range(32))] for f in b.inputFiles()}
    read = {f for f in index.search(asked(spark, "w7 w8.w9"), 5).inputFiles() if "/bucket=" in f}
    assert len({f.split("/bucket=")[1].split("/")[0] for f in read}) <= 3 and 0 < len(read) < len(every) / 4


def test_changes_beside_each_other_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/tables"
    first, second = Versions(spark, path), Versions(spark, path)
    one = spark.range(3)
    assert first.write(0, {"a": one, "b": one}, {"note": 1}) == 1
    with pytest.raises(Conflict):
        second.write(0, {"a": spark.range(9)})
    assert second.table("a").count() == 3 and second.write(1, {"a": spark.range(5)}) == 2
    assert first.table("a").count() == 5 and first.table("a", 1).count() == 3 and first.manifest()["values"] == {"note": 1}
    # of many writers with one base, one commits
    done = []

    def commit(i):
        try:
            done.append(Versions(spark, path).commit(2, {}, {"winner": i}))
        except Conflict:
            done.append(None)

    threads = [threading.Thread(target=commit, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x is None for x in done) == [False] + [True] * 5


def test_a_writer_that_dies_between_tables_leaves_the_old_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/tables")
    v.write(0, {"vectors": spark.range(3), "states": spark.range(3)})

    def broken(x):
        raise RuntimeError("killed")

    bad = spark.range(3).select(F.udf(broken, "long")("id").alias("id"))
    with pytest.raises(Exception, match="killed"):
        v.write(1, {"vectors": spark.range(7), "states": bad})
    assert v.latest() == 1 and v.table("vectors").count() == 3 and v.table("states").count() == 3


def test_rotation_keeps_what_is_referred_to(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/tables")
    v.write(0, {"a": spark.range(1), "b": spark.range(10)})
    for n in range(2, 6):
        v.write(n - 1, {"a": spark.range(n)})
    assert v.rotate(keep=2) == [1, 2, 3] and v.numbers() == [4, 5]
    assert v.table("a", 4).count() == 4 and v.table("a").count() == 5 and v.table("b").count() == 10
    assert len(list((tmp_path / "tables" / "data").iterdir())) == 3


def test_the_catalogue_search_uses_its_index(spark, tmp_path):
    media = spark.createDataFrame([(i, f"h{i}", f"/x/p{i}.jpg", f"p{i}.jpg", "image", None, False, 1, None) for i in range(4)], "id long, file_hash string, file_path string, file_name string, kind string, video_id long, deleted boolean, folder_id long, taken_at string")
    t = texts(spark, [(f"h{i}", f"sunset number {i}") for i in range(4)])
    empty = spark.createDataFrame([], "file_hash string, embedding array<double>"), spark.createDataFrame([], "segment_id long, video_id long, start_ms long, end_ms long, embedding array<double>")
    index = textsearch.TextIndex(spark, f"file://{tmp_path}/index", 4)
    index.upsert(t)
    rows = [search.search(search.Library(media, *empty, t, i), search.Query("sunset NEAR 2", limit=3)).orderBy("rank").collect() for i in (None, index)]
    assert rows[0] == rows[1] and rows[0][0].file_hash == "h2"


@pytest.mark.parametrize("name", ["empty_query_browses", "low_confidence_search", "bm25_search", "similar_items", "phrase_search"])
def test_a_single_query_builds_no_index(spark, tmp_path, monkeypatch, name):
    (tmp_path / "sf").symlink_to("/root/testdata/sf0.001")
    monkeypatch.setattr(textsearch.TextIndex, "upsert", lambda *a, **b: pytest.fail("an index was built"))
    assert Q.QUERIES[name](spark, str(tmp_path / "sf")).count() > 0


@pytest.mark.parametrize("shared", [100_000, 0])
def test_many_phrases_are_answered_as_few_are(spark, monkeypatch, shared):
    rng = random.Random(8)
    rows = [(i, random_text(rng)) for i in range(80)]
    rows += [(f"t{i}", "salt pepper") for i in range(9)] + rng.sample(rows, 20) + [(7, dict(rows)[7])] * 3  # ties and copies
    asks = [*QUERIES, "the.salt red.blue.green", "blue.blue pepper.the", "the.salt red.blue.green", "red red the.salt", "salt.pepper", "nowhere"]
    few = textsearch.bm25(texts(spark, rows), asked(spark, *asks), 4)
    want = found(few)
    monkeypatch.setattr(textsearch, "LITERALS", 0)
    monkeypatch.setattr(textsearch, "SHARED", shared)
    monkeypatch.setattr(textsearch, "PIECE", 7)
    monkeypatch.setattr(textsearch, "CELLS", 64)
    assert found(textsearch.bm25(texts(spark, rows), asked(spark, *asks), 4)) == want and len(want) > 40


@pytest.mark.parametrize("common,bits,entries", [(5000, 16, 1 << 18), (20, 6, 8), (4, 10, 3)])
def test_common_and_other_phrases_are_answered_as_few_are(spark, monkeypatch, common, bits, entries):
    rng = random.Random(5)
    rows = [(i, random_text(rng, 60)) for i in range(300)] + [(f"c{i}", "red blue " + random_text(rng, 9)) for i in range(40)]
    rows += rng.sample(rows, 60)  # copies
    asks = [f"{a}.{b} {c}.{d}.{e} {f}" for a, b, c, d, e, f in (rng.choices(WORDS[:8], k=6) for _ in range(60))]
    want = found(textsearch.bm25(texts(spark, rows), asked(spark, *asks), 3))
    for name, value in {"LITERALS": 0, "SHARED": 0, "COMMON": common, "LEAST_BITS": bits, "MOST_BITS": bits, "ENTRIES": entries, "CELLS": 64, "PARTS": 4}.items():
        monkeypatch.setattr(textsearch, name, value)
    assert found(textsearch.bm25(texts(spark, rows), asked(spark, *asks), 3)) == want and len(want) == 180


def test_hits_of_common_phrases_are_not_dealt(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS[:8], k=200))) for i in range(1500)]
    asks = [f"{a}.{b} {c}.{d}" for a, b, c, d in (rng.choices(WORDS[:8], k=4) for _ in range(300))]
    monkeypatch.setattr(textsearch, "LITERALS", 0)
    monkeypatch.setattr(textsearch, "SHARED", 0)
    core = spark.sparkContext._jsc.sc()

    def written():
        core.listenerBus().waitUntilEmpty()
        return core.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    assert textsearch.bm25(texts(spark, rows), asked(spark, *asks), 3).count() == 900
    moved = written() - before
    assert moved < sum(len(t) for _, t in rows)  # 64 phrases in each of 1,500 texts
