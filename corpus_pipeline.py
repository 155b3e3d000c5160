"""From raw documents to a training mix: five stages, each reading what its predecessor wrote.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``docs``; the last adds ``copy``, the number of the turn in which the mix takes the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontam, langid, mixing, pii, simhash
from framelake.llm.common import Staged, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, or that are far from every language learnt, go."""
    return langid.keep_accepted(spark, docs, langid.train(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return simhash.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontam.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the names of its kinds."""
    return pii.redact(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the balanced mix of sources takes them."""
    return mixing.apply(spark, docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Fingerprint groups, trained classifiers and balanced sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared folder as Parquet, read again, and deleted when the next
    stage has written its own."""
    docs, before = documents(spark, sf_dir), None
    for name, function in STAGES[:-1]:
        held = Staged(spark, function(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = held.df, held
    return STAGES[-1][1](spark, docs, sf_dir)
