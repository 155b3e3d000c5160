"""Pairs and neighbours by pivots against all pairs, and how little is shuffled where vectors form clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import vectors


def clustered(seed, groups, each, dims=16, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0) + r.normal(size=(groups * each, dims)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cases():
    r = np.random.default_rng(1)
    mixed = np.concatenate([clustered(2, 6, 20), np.zeros((3, 16)), np.repeat(clustered(3, 1, 1), 40, axis=0), r.normal(size=(30, 16)) * 3])
    return {"clusters": clustered(4, 12, 15), "random": r.normal(size=(150, 16)) / 4, "mixed": mixed, "copies": np.repeat(clustered(5, 1, 1), 90, axis=0)}


def table(spark, v):
    marks = [i % 5 == 0 for i in range(len(v))]
    return spark.createDataFrame([(i, x.tolist(), m) for i, (x, m) in enumerate(zip(v, marks))], "person_id long, centroid array<double>, changed boolean").repartition(3), np.array(marks)


@pytest.mark.parametrize("name", sorted(cases()))
@pytest.mark.parametrize("changed", [None, "changed"])
def test_pairs_equal_all_pairs(spark, name, changed):
    v = cases()[name]
    rows, marks = table(spark, v)
    got = sorted((x.a, x.b) for x in vectors.close_pairs(rows, "person_id", 0.6, changed, tile=16).collect())
    cos = v @ v.T
    want = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= 0.6 and (not changed or marks[i] or marks[j])]
    near = {(i, j) for i, j in want if abs(cos[i, j] - 0.6) < 1e-12}
    assert len(got) == len(set(got)) and set(got) ^ set(want) <= near


@pytest.mark.parametrize("name", ["clusters", "mixed", "copies"])
def test_neighbours_equal_brute_force(spark, name, monkeypatch):
    v = cases()[name]
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {(x.query_id, x["rank"]): x.cosine for x in vectors.batch_nearest(spark, rows, rows.where("vec_id % 3 = 0"), 5, least=0.3).collect()}
    cos = v @ v.T
    want = {}
    for i in range(0, len(v), 3):
        best = sorted((c for j, c in enumerate(cos[i]) if j != i and c >= 0.3), reverse=True)[:5]
        want |= {(i, k): c for k, c in enumerate(best)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert vectors.batch_nearest(spark, rows.limit(0), rows, 5, least=0.3).count() == 0


def test_what_is_shuffled_follows_the_close_tiles(spark):
    rows = lambda v: table(spark, v)[0].select(F.col("person_id").alias("id"), F.col("centroid").alias("v"), F.lit(True).alias("m"))
    n = 800
    apart = vectors.dealt_pairs(rows(clustered(6, 40, 20, spread=0.02)), 0.8, tile=20).count()
    loose = vectors.dealt_pairs(rows(np.random.default_rng(7).normal(size=(n, 16)) / 4), 0.0, tile=20).count()
    assert apart < 6 * n and loose > 3 * apart
    # without a marked row nothing but the rows themselves is dealt
    unmarked = vectors.dealt_pairs(rows(clustered(6, 40, 20, spread=0.02)).withColumn("m", F.lit(False)), 0.8, tile=20)
    assert unmarked.where("not home").count() == 0


def test_no_task_holds_a_whole_cell(spark):
    v = np.repeat(clustered(8, 1, 1), 600, axis=0)
    dealt = vectors.dealt_pairs(table(spark, v)[0].select(F.col("person_id").alias("id"), F.col("centroid").alias("v"), F.lit(True).alias("m")), 0.5, tile=20)
    assert dealt.groupBy("cell", "tile", "chunk").count().agg(F.max("count")).first()[0] < 10 * 20


def test_no_rows_no_pairs(spark):
    assert vectors.close_pairs(table(spark, cases()["random"])[0].limit(0), "person_id", 0.5).count() == 0
