"""Catalogue reads: representatives of content, filters, counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representatives(media: DataFrame) -> DataFrame:
    """The live row of the smallest id of each content hash, with the number of its live copies.

    One aggregation with map-side combine, so thousands of copies of one file cost one row a task. A null hash has
    no representative. The count is taken before any filter.
    """
    live = media.where(~F.col("deleted") & F.col("file_hash").isNotNull())
    row = F.struct(*[F.col(c) for c in media.columns])
    return live.groupBy("file_hash").agg(F.min_by(row, "id").alias("r"), F.count("*").alias("copies")).select("r.*", "copies")


def date_filter(col: Column, date_from: str | None, date_to: str | None, null_dates: str = "drop") -> Column:
    """Text comparison of ISO stamps, as stored: date_to '2024-12-31' leaves out that day's stamps. null_dates: drop or keep."""
    ok = F.lit(True)
    if date_from:
        ok = ok & (col >= date_from)
    if date_to:
        ok = ok & (col <= date_to)
    return F.coalesce(ok, F.lit(null_dates == "keep"))


def filtered(media: DataFrame, kind: str | None = None, folder_id: int | None = None, date_from: str | None = None, date_to: str | None = None, null_dates: str = "drop") -> DataFrame:
    """Representatives that pass all given filters. A content is in a folder if any live copy is."""
    out = representatives(media)
    if date_from or date_to:
        out = out.where(date_filter(F.col("taken_at"), date_from, date_to, null_dates))
    if kind:
        out = out.where(F.col("kind") == kind)
    if folder_id is not None:
        inside = media.where(~F.col("deleted") & (F.col("folder_id") == folder_id)).select("file_hash")
        out = out.join(inside, "file_hash", "left_semi").select(out.columns)
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, created_at: str, id: int, limit: int) -> DataFrame:
    """The page after a known last row, newest first: a filter in place of an offset, so deep pages cost no more."""
    at = F.lit(created_at).cast("timestamp_ntz")
    return page(rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > id))), [F.desc("created_at"), F.asc("id")], limit)


def located(media: DataFrame) -> DataFrame:
    return representatives(media).where("lat is not null and lng is not null")


def grid(media: DataFrame, zoom: int, pixels: int = 60) -> DataFrame:
    """Markers of a web map: located representatives binned to squares of so many pixels at a zoom level."""
    world = 256 * 2**zoom
    lat = F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("lat"))))
    x = F.floor((F.col("lng") + 180) / 360 * world / pixels)
    y = F.floor((0.5 - F.log(F.tan(lat) + 1 / F.cos(lat)) / (2 * F.pi())) * world / pixels)
    return located(media).groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def rank_for_zoom(zoom: Column) -> Column:
    """The least important rank of a place that a map shows at a zoom level."""
    return F.when(zoom <= 2, -1).when(zoom <= 3, 1).when(zoom <= 6, F.ceil(zoom).cast("int") - 2).otherwise(99)


def library_counts(media: DataFrame) -> DataFrame:
    """Representatives by kind, and 'all'."""
    by = representatives(media).groupBy("kind").agg(F.count("*").alias("n"))
    return by.unionByName(by.agg(F.lit("all").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def library_stats(media: DataFrame, vectors: DataFrame, ocr: DataFrame) -> DataFrame:
    """total, unique_total, indexed (content with a vector), ocred (all scanned content, also without a live row)."""
    live = media.where(~F.col("deleted"))
    has = vectors.select("file_hash").distinct().withColumn("has", F.lit(1))
    hashes = live.groupBy("file_hash").agg(F.count("*").alias("n")).join(has, "file_hash", "left")
    head = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("file_hash").alias("unique_total"), F.count("has").alias("indexed"))
    return head.crossJoin(F.broadcast(ocr.agg(F.countDistinct("file_hash").alias("ocred"))))  # one row


def folder_counts(folders: DataFrame, media: DataFrame) -> DataFrame:
    """Live rows of every folder; 0 for an empty one."""
    live = media.where(~F.col("deleted")).groupBy("folder_id").agg(F.count("*").alias("n"))
    return folders.join(live, "folder_id", "left").select(*folders.columns, F.coalesce("n", F.lit(0)).alias("photos"))


def media_totals(videos: DataFrame, segment_ms: int = 32_000) -> DataFrame:
    """Segments due, by whole-number ceiling, and files and bytes by kind."""
    due = F.expr(f"(duration_ms + {segment_ms - 1}) div {segment_ms}")
    return videos.where("duration_ms is not null and not deleted").groupBy("kind").agg(F.sum(due).alias("segments_due"), F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def locations(media: DataFrame, folders: DataFrame) -> DataFrame:
    """All live paths of each content with their folders."""
    rows = media.where(~F.col("deleted")).join(folders, "folder_id").groupBy("file_hash").agg(F.sort_array(F.collect_list("file_path")).alias("paths"), F.countDistinct("folder_id").alias("folders"))
    return rows


def composition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def moving_mean(rows: DataFrame, key: str, order: str, value: str, last: int = 8) -> DataFrame:
    """Mean of the last values, e.g. for an estimate of the time that is left."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - last, 0)
    return rows.withColumn("mean_last", F.avg(value).over(w))
