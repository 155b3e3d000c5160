"""Exact token-length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded once and aggregated by encoded length (map-side combined, one row per distinct length);
suffix sums over that histogram answer every limit. Null and empty texts have length 0; repeated rows count
repeatedly; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import slices, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in one block of the two-level suffix sum.
BLOCK = 1024
_encoders: dict[int, object] = {}


def encoder(raw: bytes, pattern: str):
    """One encoder per worker process."""
    import tiktoken

    key = hash((raw, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def lengths(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per input row: doc_id and n_tokens of the whole text."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: 1-2 MB

    def run(batches):
        import pyarrow as pa

        enc = encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """length, n_docs, docs_at_least, tokens_at_least, truncated_tokens, share_up_to for each distinct length.

    Suffix sums are taken within blocks of lengths and then over the blocks' totals, so no task orders the
    whole histogram.
    """
    hist = stage(spark, counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    block = F.floor(F.col("length") / BLOCK)
    hist = hist.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(Window.partitionBy(F.lit(1))).alias("all_docs"),
        F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        hist.withColumn("docs_in", F.sum("n_docs").over(suffix))
        .withColumn("tokens_in", F.sum("tokens").over(suffix))
        .join(blocks, "block")
        .withColumn("docs_at_least", F.col("docs_in") + F.col("docs_after"))
        .withColumn("tokens_at_least", F.col("tokens_in") + F.col("tokens_after"))
    )
    return out.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def answers(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents cut, tokens kept when texts are truncated there, and all tokens."""
    one = [
        hist.agg(
            F.lit(limit).cast("long").alias("context_limit"),
            F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")).alias("tokens_kept"),
            F.sum(F.col("length") * F.col("n_docs")).alias("tokens_all"),
        )
        for limit in limits
    ]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of documents doesn't exceed."""
    return hist.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))
