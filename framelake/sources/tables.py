"""Sources and sinks: listings, tables, snapshots, JSON lines, GeoJSON places."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources import files

_local: dict[str, str | None] = {}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder; see ``files``. Of videos and sounds only the ends are read."""
    return files.listing(spark, folder)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema given, nothing is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Write a new version of a table beside the old one; the caller then switches to it."""
    df.write.mode("errorifexists").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Only a single-process session (``local[...]``) may leave
    the setting unset; it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="framelake-")
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def staged(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """A table written to the shared folder, and read again: what is used several times is computed once, and a lost executor
    costs no recomputation."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def basemap(places: DataFrame) -> DataFrame:
    """Rows (name, scalerank, pop, capital, ring array<struct<lng, lat>>): what a small map shows, thinned.

    Kept are scalerank up to 4, two million people, or capitals; coordinates have three decimals and no point twice in a row.
    """
    shown = places.where("scalerank <= 4 or pop >= 2000000 or capital")
    rounded = F.transform("ring", lambda p: F.struct(F.round(p["lng"], 3).alias("lng"), F.round(p["lat"], 3).alias("lat")))
    shown = shown.withColumn("ring", rounded)
    return shown.withColumn("ring", F.filter("ring", lambda p, i: (i == 0) | (p != F.get("ring", i - 1))))
