"""Health checks, timings and backups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.tables import staged


def top_errors(tasks: DataFrame, limit: int = 5) -> DataFrame:
    return tasks.where("status = 'error'").groupBy("task_type", F.substring("error_msg", 1, 80).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "task_type", "error").limit(limit)


def checks(media: DataFrame, vectors: DataFrame, faces: DataFrame) -> DataFrame:
    """(check, n): rows that break an invariant of the catalogue."""
    live = media.where("not deleted").select("file_hash")
    row = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    dims = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).agg(F.lit("mixed_dimensions").alias("check"), (F.count("*") - 1).alias("n"))
    return (
        row("vectors_without_live_media", vectors.join(live, "file_hash", "left_anti"))
        .unionByName(row("media_without_hash", media.where("file_hash is null")))
        .unionByName(row("duplicate_paths", media.groupBy("file_path").count().where("count > 1")))
        .unionByName(row("people_of_one_face", faces.where("person_id is not null").groupBy("person_id").count().where("count < 2")))
        .unionByName(dims)
    )


#: Parts of a range in one round of the search for a rank, and distinct values that a window may see.
BINS, FEW = 1024, 65_536


def percentiles(samples: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """Nearest-rank p50, p95 and maximum of finite values: sorted[min(n - 1, floor(n * p))]; nulls don't count.

    Exact, and no task sees all values of a key: for each rank the range of values that holds it is cut into BINS parts,
    counted map-side, and the part with the rank is the next range, until it has at most ``few`` distinct values, which a
    window ranks. Ranges are one row a key and rank.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    counted = staged(samples.sparkSession, counted, "values")
    whole = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"))
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("p")).cast("long"))
    ranges = whole.withColumn("max", F.col("hi")).withColumn("p", F.explode(F.array(F.lit(0.5), F.lit(0.95)))).withColumn("r", rank).withColumn("before", F.lit(0).cast("long"))
    named = [F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)]
    inside = lambda: counted.join(ranges.select(*named, "p", "r", "lo", "hi", "before", "n", "max"), [F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(keys)] + [F.col("v").between(F.col("lo"), F.col("hi"))]).drop(*[f"of_{i}" for i in range(len(keys))])
    while ranges.where((F.col("m") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = inside().groupBy(*keys, "p", "r", "before", "n", "max", F.when(F.col("lo") < F.col("hi"), part).otherwise(F.lit(0)).alias("bin"))
        bins = bins.agg(F.sum("c").alias("c"), F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("bin"))
        found = bins.withColumn("upto", upto).where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r")))
        ranges = staged(samples.sparkSession, found.withColumn("before", F.col("upto") - F.col("c")).select(*keys, "n", "lo", "hi", "m", "max", "p", "r", "before"), "ranges")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("v"))
    at = inside().withColumn("upto", upto).where("upto > r").groupBy(*keys, "n", "max", "p").agg(F.min("v").alias("v"))
    of = lambda p: F.max(F.when(F.col("p") == p, F.col("v")))
    return at.groupBy(*keys, "n", "max").agg(of(0.5).alias("p50"), of(0.95).alias("p95")).select(*keys, "n", "p50", "p95", "max")


def newest(samples: DataFrame, order: str, n: int = 500) -> DataFrame:
    """The ring buffer's content: the last n samples."""
    return samples.orderBy(F.desc(order)).limit(n)


def expired_backups(files: DataFrame, keep: int, prefix: str = "library.db.bak.") -> DataFrame:
    """Backups older than the newest ``keep`` (one at least); foreign names are left alone."""
    own = files.where(F.col("name").rlike("^" + re.escape(prefix) + r"\d{8}T\d{6}Z$"))
    rank = F.row_number().over(Window.orderBy(F.desc("name")))
    return own.withColumn("r", rank).where(F.col("r") > max(1, keep)).drop("r")


def plan_warnings(df: DataFrame) -> list[str]:
    """What to look at in a physical plan: nested loops, cartesian products, single partitions, Python rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    marks = {"CartesianProduct": "cartesian product", "BroadcastNestedLoopJoin": "nested loop join", "SinglePartition": "all rows in one partition", "BatchEvalPython": "row-at-a-time Python"}
    return [text for mark, text in marks.items() if mark in plan]
