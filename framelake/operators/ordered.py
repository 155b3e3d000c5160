"""Ordered scans whose keys may hold any share of the rows.

A window over a key puts all its rows into one task. Here rows are cut into pieces by range of (key, order), so that a
large key spans many pieces; each piece is scanned on its own, and a second pass over one small row for each key and piece
hands on what a piece needs of those before it. Rows that agree in key and order share a piece. Null keys are one key, null
orders come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.tables import staged

PIECE, NUMBER, CARRY = "_piece", "_number", "_carry"


def in_pieces(rows: DataFrame, key: str, order: list[str], pieces: int | None = None) -> DataFrame:
    """The rows with the number of their piece; written once, as ranges are drawn from a sample and must stay as they are."""
    spark = rows.sparkSession
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return staged(spark, rows.repartitionByRange(n, key, *order).withColumn(PIECE, F.spark_partition_id()), "pieces")


def with_carry(scanned: DataFrame, parts: DataFrame, key: str, carry: Column) -> DataFrame:
    """Each row with what the pieces before its own hand on; parts has a row for each key and piece."""
    handed = parts.select(F.col(key).alias("_key"), F.col(PIECE).alias("_of"), carry.alias(CARRY)).where(F.col(CARRY).isNotNull())
    return scanned.join(handed, (F.col(PIECE) == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key", "_of", PIECE)


def forward_filled(rows: DataFrame, key: str, order: str, value: str, pieces: int | None = None) -> DataFrame:
    """A missing value takes the last one before it."""
    cut = in_pieces(rows, key, [order], pieces)
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(PIECE, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # the last value of a piece: struct(true, order) is above every null order too
    parts = cut.groupBy(PIECE, key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(F.lit(True), order))).alias("_last"))
    before = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    out = with_carry(cut.withColumn(value, inside), parts, key, F.last("_last", ignorenulls=True).over(before))
    return out.withColumn(value, F.coalesce(F.col(value), F.col(CARRY))).select(rows.columns)


def moving_mean(rows: DataFrame, key: str, order: str, value: str, last: int = 8, pieces: int | None = None) -> DataFrame:
    """Mean of the last values (those that are missing count as rows only), e.g. for an estimate of the time that is left."""
    cut = in_pieces(rows, key, [order], pieces)
    w = Window.partitionBy(PIECE, key).orderBy(order)
    frame = w.rowsBetween(1 - last, 0)
    scanned = cut.withColumn(NUMBER, F.row_number().over(w)).withColumn("_sum", F.sum(F.col(value).cast("double")).over(frame)).withColumn("_n", F.count(value).over(frame))
    # the last rows of each piece, at most last - 1 of them, newest first
    from_end = F.row_number().over(Window.partitionBy(PIECE, key).orderBy(F.desc(order)))
    ends = cut.withColumn("_r", from_end).where(F.col("_r") < last)
    parts = ends.groupBy(PIECE, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(value).cast("double").alias("v")))), lambda x: F.struct(x["v"].alias("v"))).alias("_end"))
    # each piece has a row of the key, so last - 1 pieces before hold enough of them
    before = F.collect_list("_end").over(Window.partitionBy(key).orderBy(PIECE).rowsBetween(1 - last, -1))
    out = with_carry(scanned, parts, key, F.flatten(F.reverse(before)))
    lacking = F.greatest(F.lit(0), F.lit(last) - F.col(NUMBER))
    taken = F.filter(F.transform(F.slice(F.coalesce(F.col(CARRY), F.array().cast("array<struct<v:double>>")), F.lit(1), lacking), lambda x: x["v"]), lambda v: v.isNotNull())
    total = F.coalesce("_sum", F.lit(0.0)) + F.aggregate(taken, F.lit(0.0), lambda a, v: a + v)
    count = F.col("_n") + F.size(taken)
    return out.withColumn("mean_last", F.when(count > 0, total / count)).select(*rows.columns, "mean_last")


def lags(rows: DataFrame, key: str, order: str, expected_ms: float, pieces: int | None = None) -> DataFrame:
    """How many milliseconds later than expected each tick came; ticks of one time by id."""
    cut = in_pieces(rows, key, [order, "id"], pieces)
    w = Window.partitionBy(PIECE, key).orderBy(order, "id")
    scanned = cut.withColumn(NUMBER, F.row_number().over(w)).withColumn("_before", F.lag(order).over(w))
    parts = cut.groupBy(PIECE, key).agg(F.max(F.struct(order, "id"))[order].alias("_last"))
    out = with_carry(scanned, parts, key, F.lag("_last").over(Window.partitionBy(key).orderBy(PIECE)))
    before = F.when(F.col(NUMBER) == 1, F.col(CARRY)).otherwise(F.col("_before"))
    late = F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return out.withColumn("lag_ms", F.greatest(F.lit(0.0), late / 1000.0 - expected_ms)).select(*rows.columns, "lag_ms")
