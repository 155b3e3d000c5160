"""The registered corpus queries on the smallest tables, against SQL where there is any."""

import os
from collections import Counter

import pytest

from framelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "clients", "vendors", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, SF).select(*want.columns)
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_covers_the_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = Q.QUERIES[name](spark, SF)
    if name == "op8_token_counts":
        assert got.agg({"n_docs": "sum"}).first()[0] == n
    elif name != "op7_decontamination":
        assert got.count() == n and got.select("doc_id").distinct().count() == n
    else:
        assert set(got.columns) >= {"doc_id", "item_id", "containment"}


def test_the_entry_registers_all():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith(("op", "pipeline"))}
