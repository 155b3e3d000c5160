"""The clustering plan through its DataFrame form, and suggestions."""

import numpy as np
import pytest

from framelake.operators import people

DIM = 16


def axis(k, lean=None, share=0.0):
    v = np.zeros(DIM)
    v[k] = 1.0
    if lean is not None:
        v[lean] = share
    return (v / np.linalg.norm(v)).tolist()


def planned(spark, rows, names=None, rejections=None, dismissed=None):
    """rows: face_id, quality, person_id, dormant, vector."""
    faces = spark.createDataFrame(rows, "face_id long, quality double, person_id long, dormant boolean, embedding array<double>").repartition(3)
    table = lambda x, schema: None if x is None else spark.createDataFrame(x, schema)
    plan = people.cluster_plan(spark, faces, table(names, "person_id long, name string"), table(rejections, "face_id long, person_id long"), table(dismissed, "a long, b long"))
    return faces, plan, {(r.face_id, r.action, r.target) for r in plan.collect()}


def person(p, k, n=4, at=1000, **kw):
    return [(at + 10 * p + i, 0.9, p, False, axis(k, **kw)) for i in range(n)]


def test_dormant_faces_are_called_back(spark):
    rows = [(1, 0.9, None, False, axis(0)), (2, 0.3, None, True, axis(0, 1, 0.3)), (3, 0.3, None, True, axis(5)), (4, 0.05, None, True, axis(0))]
    assert planned(spark, rows)[2] == {(1, "create", 1), (2, "create", 1)}


def test_rejected_faces_stay_away(spark):
    rows = person(1, 0) + [(1, 0.9, None, False, axis(0)), (2, 0.9, None, False, axis(0, 1, 0.2))]
    assert planned(spark, rows)[2] == {(1, "assign", 1), (2, "assign", 1)}
    assert planned(spark, rows, rejections=[(1, 1), (2, 1)])[2] == {(1, "create", 1), (2, "create", 1)}


def test_people_merge_into_the_named_one(spark):
    near = axis(0, 1, 0.6)
    rows = person(1, 0, n=6) + [(2000 + i, 0.9, 2, False, near) for i in range(3)] + [(1, 0.9, None, False, near)]
    faces, plan, got = planned(spark, rows, names=[(2, "Ann"), (1, " ")])
    assert got == {(1, "assign", 2), (1, "merge", 2)}
    after = {r.face_id: r.person_id for r in people.apply_plan(faces, plan).collect()}
    assert set(after.values()) == {2}
    assert planned(spark, rows, names=[(2, "Ann"), (1, "Bob")])[2] == {(1, "assign", 2)}


def test_dismissed_pairs_and_rejections_do_not_merge(spark):
    near = axis(0, 1, 0.6)
    rows = person(1, 0, n=6) + [(2000 + i, 0.9, 2, False, near) for i in range(3)] + [(1, 0.9, None, False, near)]
    assert planned(spark, rows, dismissed=[(2, 1)])[2] == {(1, "assign", 2)}
    assert planned(spark, rows, rejections=[(1, 1)])[2] == {(1, "assign", 2)}
    assert (2, "merge", 1) in planned(spark, rows)[2]


def test_a_rejection_also_holds_against_who_took_the_person_in():
    v = lambda *x: np.array([*x, *[0.0] * (4 - len(x))]) / np.linalg.norm(x)
    people_ = [(1, False, v(1, 0.02), 9), (2, False, v(1, 0.0), 5), (3, False, v(1, 0.9), 3)]
    pending = [(10, v(1, 0.01), 0.9), (11, v(1, 1.0), 0.9)]
    plan = people.plan_clusters(pending, [], people_, {11: {2}}, set())
    assert (2, 1) in plan["merges"] or (1, 2) in plan["merges"]
    assert not any(3 in m for m in plan["merges"])


def test_merges_name_who_stays_in_the_end(spark):
    plan = people.plan_clusters([(i, np.array([1.0, 0.01 * i]) / np.hypot(1, 0.01 * i), 0.9) for i in range(3)], [], [(p, p == 3, np.array([1.0, 0.1 * p]) / np.hypot(1, 0.1 * p), 2 + p) for p in (1, 2, 3)], {}, set())
    assert {stays for _, stays in plan["merges"]} == {3} and {gone for gone, _ in plan["merges"]} == {1, 2}


def test_suggestions_name_first_and_sort_by_similarity_alone(spark):
    c = {1: axis(0), 2: axis(0, 1, 0.3), 3: axis(0, 1, 0.8), 4: axis(2), 5: axis(2, 3, 0.5), 6: axis(2, 3, 0.1)}
    rows = spark.createDataFrame([(p, v, "Ann" if p in (3, 5) else None) for p, v in c.items()], "person_id long, centroid array<double>, name string")
    none = spark.createDataFrame([(4, 6)], "a long, b long")
    sim = lambda a, b: float(np.dot(c[a], c[b]))
    pairs = [(a, b) for a in c for b in c if a < b and sim(a, b) >= 0.4 and not {a, b} <= {3, 5} and (a, b) != (4, 6)]
    want = [(b, a) if b in (3, 5) else (a, b) for a, b in sorted(pairs, key=lambda p: -sim(*p))]
    for limit in (2, 4, 20):
        got = people.suggestions(rows, none, 0.4, limit).collect()
        assert [(r.a, r.b) for r in got] == want[:limit]
        assert [r.similarity for r in got] == pytest.approx([sim(r.a, r.b) for r in got])


@pytest.mark.parametrize("changed", [None, "changed"])
def test_close_pairs_over_many_tiles(spark, monkeypatch, changed):
    from framelake.operators import vectors

    monkeypatch.setattr(vectors, "TILE", 7)
    r = np.random.default_rng(3)
    v = r.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v[i].tolist(), i % 9 == 0) for i in range(40)], "person_id long, centroid array<double>, changed boolean")
    got = {(x.a, x.b): x.similarity for x in vectors.close_pairs(rows, "person_id", 0.5, changed).collect()}
    want = {(i, j): float(v[i] @ v[j]) for i in range(40) for j in range(i + 1, 40) if v[i] @ v[j] >= 0.5 and (not changed or i % 9 == 0 or j % 9 == 0)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("least", [None, 0.2])
def test_many_queries_make_a_grid(spark, monkeypatch, least):
    from framelake.operators import vectors

    monkeypatch.setattr(vectors, "PIECE", 16)
    monkeypatch.setattr(vectors, "CORPUS", 50)
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(180, 5)), 1)
    v[17] = v[18] = v[19]  # ties
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(180)], "vec_id long, embedding array<double>").repartition(4)
    want = {}
    for q in range(0, 180, 2):
        near = sorted((-float(v[q] @ v[j]), j) for j in range(180) if j != q and (least is None or v[q] @ v[j] >= least))[:6]
        want[q] = [j for _, j in near]
    for most in (4096, 30):
        monkeypatch.setattr(vectors, "QUERIES", most)
        got = {}
        for x in sorted(vectors.batch_nearest(spark, rows, rows.where("vec_id % 2 = 0"), 6, least=least).collect(), key=lambda x: (x.query_id, x.rank)):
            got.setdefault(x.query_id, []).append(x.neighbour_id)
        assert got == {q: w for q, w in want.items() if w}
    assert vectors.batch_nearest(spark, rows, rows.limit(0), 6).count() == 0
