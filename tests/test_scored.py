"""Vectors are scored where they are read: no join or window of a search shuffles them, and the results stay."""

import dataclasses
import os
import re

import pytest

import framelake.queries as Q
from framelake.operators import search
from framelake.plans import entities as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def exchanged(df) -> list[str]:
    """What enters each exchange of the plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)


@pytest.fixture
def large(spark):
    """Plans as over large tables, where nothing is small enough to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["low_confidence_search", "fused_search", "segment_best_per_video", "similar_items"])
def test_no_vector_is_shuffled(large, name):
    found = exchanged(Q.QUERIES[name](large, SF))
    assert found and any("cosine" in x for x in found) and not [x for x in found if "embedding" in x]


@pytest.mark.parametrize("text,vec_id", [("IMG_1", 7), ("zzqqxx", None)])
def test_scored_vectors_find_what_vectors_find(spark, text, vec_id):
    lib = Q.library(spark, SF)
    q = search.Query(text, Q.vector_of(spark, SF, vec_id) if vec_id else [0.0] * 64, 30)
    rows = [search.search(x, q).orderBy("rank").collect() for x in (lib, dataclasses.replace(lib, scored=None))]
    assert rows[0] == rows[1] and len(rows[0]) > 5


def test_the_hash_of_one_vector(spark, tmp_path):
    docs = [(0, "a"), (1, "b"), (2, "a"), (3, None), (4, None), (5, "c")]
    spark.createDataFrame([(i, t, "en", "src1", 99) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [0.5], 1) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    for i in range(7):  # first of its copies, a copy, a null text and its copy, no vector, no document
        assert E.vector_hash(spark, sf, i).collect() == E.vectors(spark, sf).where(f"vec_id = {i}").select("file_hash").collect()
