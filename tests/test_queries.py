"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import numpy as np
import pytest

import framelake.queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def normal(df):
    def show(x):
        if x is None or x != x:
            return "NULL"
        return repr(round(float(x), 5)) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(show)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = normal(Q.QUERIES[name](spark, SF).toPandas()), normal(duck.sql(Q.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert (got == want).all().all()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cluster_plan_is_of_the_whole_table(spark):
    from framelake.operators import people

    faces, names, refused, apart = Q.constraints(spark, SF)
    rows = sorted(faces.collect(), key=lambda r: r.face_id)
    known, rejected = {}, {}
    for r in rows:
        if r.person_id is not None:
            known.setdefault(r.person_id, []).append(np.array(r.embedding, float))
    for r in refused.collect():
        rejected.setdefault(r.face_id, set()).add(r.person_id)
    centre = {p: np.sum(v, axis=0) / np.linalg.norm(np.sum(v, axis=0)) for p, v in known.items()}
    free = [(r.face_id, np.array(r.embedding, float), r.quality, r.dormant) for r in rows if r.person_id is None]
    named = {r.person_id for r in names.collect() if r.name}
    plan = people.plan_clusters([f[:3] for f in free if not f[3]], [f[:3] for f in free if f[3]], [(p, p in named, centre[p], len(known[p])) for p in sorted(known)], rejected, {(r.a, r.b) for r in apart.collect()})
    want = [(f, "assign", p) for f, p in plan["assign"]] + [(f, "create", min(c)) for c in plan["create"] for f in c] + [(f, "dormant", -1) for f in plan["dormant"]] + [(a, "merge", b) for a, b in plan["merges"]]
    got = [(r.face_id, r.action, r.target) for r in Q.QUERIES["cluster_plan"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) >= sum(not f[3] for f in free)


def test_faces_of_one_person_meet_whatever_their_numbers(spark):
    from framelake.operators import people

    v = [[float(i == k) for i in range(8)] for k in range(8)]
    rows = [(n, 0.9, None, v[k]) for k in range(3) for n in (k, k + 11)] + [(50, 0.9, None, v[7]), (51, 0.05, None, v[0])]
    faces = spark.createDataFrame(rows, "face_id long, quality double, person_id long, embedding array<double>").repartition(4)
    got = {(r.face_id, r.action, r.target) for r in people.cluster_plan(spark, faces).collect()}
    assert got == {(n, "create", k) for k in range(3) for n in (k, k + 11)} | {(50, "dormant", -1), (51, "dormant", -1)}
