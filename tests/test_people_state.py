"""People kept up by differences equal those computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import people, peoplestate

SCHEMA = "face_id long, person_id long, quality double, confidence double, embedding array<double>"


def face(r, i, person):
    return (i, person, r.choice([None, 0.1, 0.5, round(r.random(), 3)]), round(r.random(), 2), None if i % 31 == 0 else [r.gauss(0, 1) for _ in range(4)])


def changes_of(before, after):
    old, new = {f[0]: f for f in before}, {f[0]: f for f in after}
    rows = []
    for i in sorted(set(old) | set(new)):
        was, now = old.get(i), new.get(i)
        if was == now or not any(f and f[1] is not None for f in (was, now)):
            continue
        rows.append((i, was[1] if was else None, now[1] if now else None, *(now or was)[2:]))
    return rows


def agrees(spark, got, rows):
    want = {r.person_id: r for r in people.person_list(spark.createDataFrame(rows, SCHEMA)).collect()}
    centre = {r.person_id: r.centroid for r in people.person_centroids(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {r.person_id: r for r in got.collect()}
    assert set(got) == set(want)
    for p, r in got.items():
        assert r.n == want[p].faces and r.cover_face_id == want[p].cover_face_id
        assert r.centroid == pytest.approx(centre.get(p, []), abs=1e-9)
        order = sorted((f for f in rows if f[1] == p), key=lambda f: (-1.0 if f[2] is None else f[2], f[3], -f[0]), reverse=True)
        assert r.covers == [f[0] for f in order[: len(r.covers)]] and r.covers


def test_changes_and_merges_equal_a_recomputation(spark, tmp_path):
    r = random.Random(8)
    rows = [face(r, i, r.choice([1, 1, 1, 2, 3, 4, 5, None])) for i in range(300)]
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = peoplestate.PeopleState(spark, str(tmp_path / "s"), 4)
    store.build(table(rows))
    agrees(spark, store.people(), rows)

    best = sorted((f for f in rows if f[1] == 1), key=lambda f: (-1.0 if f[2] is None else f[2], f[3], -f[0]), reverse=True)
    gone = {f[0] for f in best[: peoplestate.KEPT]} | {f[0] for f in rows if f[1] == 5}  # a whole list, and a whole person
    after = [(f[0], 2 if f[0] % 11 == 0 and f[1] == 4 else 6 if f[1] is None and f[0] % 3 == 0 else f[1], *f[2:]) for f in rows if f[0] not in gone]
    after += [face(r, 1000 + i, r.choice([1, 2, 7])) for i in range(40)]
    store.change(spark.createDataFrame(changes_of(rows, after), "face_id long, before long, after long, quality double, confidence double, embedding array<double>"), table(after))
    agrees(spark, store.people(), after)

    store.merge(spark.createDataFrame([(2, 3), (4, 3)], "from_id long, into_id long"))
    merged = [(f[0], 3 if f[1] in (2, 4) else f[1], *f[2:]) for f in after]
    agrees(spark, store.people(), merged)


def test_only_touched_folders_change(spark, tmp_path):
    r = random.Random(2)
    rows = [face(r, i, i % 20) for i in range(1, 200)]
    store = peoplestate.PeopleState(spark, str(tmp_path / "s"), 16)
    store.build(spark.createDataFrame(rows, SCHEMA))
    before = store.versions.manifest()["tables"]
    one = next(f for f in rows if f[1] == 7)
    never = spark.range(1).select(*[F.raise_error(F.lit("faces were read")).cast(t).alias(c) for c, t in (("face_id", "long"), ("person_id", "long"), ("quality", "double"), ("confidence", "double"))])
    store.change(spark.createDataFrame([(one[0], 7, None, *one[2:])], "face_id long, before long, after long, quality double, confidence double, embedding array<double>"), never)
    now = store.versions.manifest()["tables"]
    assert sum(before[t] != now.get(t) for t in before) == 1
    agrees(spark, store.people(), [f for f in rows if f is not one])


def test_no_faces_no_people(spark, tmp_path):
    store = peoplestate.PeopleState(spark, str(tmp_path / "s"))
    store.build(spark.createDataFrame([], SCHEMA))
    assert store.people().count() == 0
