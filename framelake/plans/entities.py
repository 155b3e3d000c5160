"""The catalogue's entities, derived from the driver's tables; each with the same derivation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.media import SEGMENT_MS
from framelake.operators.vectors import scored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per path. Content is addressed by the hash of the text; tiny files count as deleted; two folders lack EXIF."""
    d = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "video").when(F.col("lang") == "es", "audio").otherwise("image")
    ext = F.when(F.col("lang") == "de", ".mp4").when(F.col("lang") == "es", ".MP3").when(F.col("lang") == "fr", ".png").otherwise(".JPG")
    name = F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), ext)
    folder_id = F.substring("source", 4, 10).cast("long")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("folder"),
        folder_id.alias("folder_id"),
        F.concat_ws("/", F.lit("/lib"), F.col("source"), name).alias("file_path"),
        name.alias("file_name"),
        F.col("n_chars").alias("file_size"),
        F.md5(F.col("text").cast("binary")).alias("file_hash"),
        kind.alias("kind"),
        F.when(kind != "image", folder_id % 10).alias("video_id"),
        F.when(kind != "image", F.col("n_chars") * 100).alias("duration_ms"),
        F.when(~F.col("source").isin("src3", "src7"), F.concat(day.cast("string"), F.lit("T12:00:00.000Z"))).alias("taken_at"),
        F.when(F.col("source") != "src5", (F.col("doc_id") * 37 % 180) - 89.5).alias("lat"),
        F.when(F.col("source") != "src5", (F.col("doc_id") * 53 % 360) - 179.5).alias("lng"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
        (F.col("n_chars") < 60).alias("deleted"),
    )


MEDIA = """media AS (
  SELECT doc_id AS id, source AS folder, CAST(substr(source, 4) AS BIGINT) AS folder_id,
    '/lib/' || source || '/IMG_' || doc_id || CASE lang WHEN 'de' THEN '.mp4' WHEN 'es' THEN '.MP3' WHEN 'fr' THEN '.png' ELSE '.JPG' END AS file_path,
    'IMG_' || doc_id || CASE lang WHEN 'de' THEN '.mp4' WHEN 'es' THEN '.MP3' WHEN 'fr' THEN '.png' ELSE '.JPG' END AS file_name,
    n_chars AS file_size, md5(text) AS file_hash,
    CASE lang WHEN 'de' THEN 'video' WHEN 'es' THEN 'audio' ELSE 'image' END AS kind,
    CASE WHEN lang IN ('de', 'es') THEN CAST(substr(source, 4) AS BIGINT) % 10 END AS video_id,
    CASE WHEN lang IN ('de', 'es') THEN n_chars * 100 END AS duration_ms,
    CASE WHEN source NOT IN ('src3', 'src7') THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') || 'T12:00:00.000Z' END AS taken_at,
    CASE WHEN source <> 'src5' THEN (doc_id * 37 % 180) - 89.5::DOUBLE END AS lat,
    CASE WHEN source <> 'src5' THEN (doc_id * 53 % 360) - 179.5::DOUBLE END AS lng,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, n_chars < 60 AS deleted
  FROM documents)"""


def _embeddings(spark: SparkSession, sf_dir: str, query: list[float] | None) -> tuple[DataFrame, str]:
    """The vectors and the name of their column; with a query, their cosines to it, computed where they are read."""
    e = _table(spark, sf_dir, "embeddings")
    return (e, "embedding") if query is None else (scored(e, query), "cosine")


def vectors(spark: SparkSession, sf_dir: str, query: list[float] | None = None) -> DataFrame:
    """Image vectors by content hash; a hash that several documents share has the vector of the smallest id.

    With a query, ``cosine`` stands in place of ``embedding``."""
    e, value = _embeddings(spark, sf_dir, query)
    m = media(spark, sf_dir).groupBy("file_hash").agg(F.min("id").alias("vec_id"))
    return m.join(e, "vec_id").select("vec_id", "file_hash", value, "label")


def vector_hash(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    """The file_hash of one of ``vectors``, or no row: only copies of that document are grouped."""
    m = media(spark, sf_dir).select(F.col("id").alias("vec_id"), "file_hash")
    own = m.where(F.col("vec_id") == vec_id).select(F.col("file_hash").alias("own")).distinct()  # one row
    copies = m.join(F.broadcast(own), F.col("file_hash").eqNullSafe(F.col("own")), "left_semi")
    first = copies.groupBy("file_hash").agg(F.min("vec_id").alias("vec_id")).where(F.col("vec_id") == vec_id)
    return first.join(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("vec_id"), "vec_id", "left_semi").select("file_hash")


VECTORS = """vectors AS (
  SELECT vec_id, file_hash, embedding::DOUBLE[] AS embedding, label
  FROM (SELECT min(id) AS vec_id, file_hash FROM media GROUP BY file_hash) JOIN embeddings USING (vec_id))"""


def video_segments(spark: SparkSession, sf_dir: str, query: list[float] | None = None) -> DataFrame:
    """Segments of 32 s: the vectors of one label are the segments of one video. With a query as in ``vectors``."""
    e, value = _embeddings(spark, sf_dir, query)
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("vec_id").alias("segment_id"), F.col("label").cast("long").alias("video_id"), (n * SEGMENT_MS).cast("long").alias("start_ms"), ((n + 1) * SEGMENT_MS).cast("long").alias("end_ms"), value)


SEGMENTS = """segments AS (
  SELECT vec_id AS segment_id, label::BIGINT AS video_id, 32000 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS start_ms,
    32000 * row_number() OVER (PARTITION BY label ORDER BY vec_id) AS end_ms, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with quality; those whose quality is over a half belong to the person of their label, the others to nobody yet."""
    e = _table(spark, sf_dir, "embeddings")
    quality = (F.col("vec_id") * 37 % 100) / 100.0
    return e.select(F.col("vec_id").alias("face_id"), quality.alias("quality"), ((F.col("vec_id") * 13 % 50) / 50.0).alias("confidence"), F.when(quality > 0.5, F.col("label").cast("long")).alias("person_id"), "embedding")


FACES = """faces AS (
  SELECT vec_id AS face_id, (vec_id * 37 % 100) / 100.0::DOUBLE AS quality, (vec_id * 13 % 50) / 50.0::DOUBLE AS confidence,
    CASE WHEN (vec_id * 37 % 100) / 100.0::DOUBLE > 0.5 THEN label::BIGINT END AS person_id, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work queue from events. subject_id names a video for extract_frames, else a photo."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "thumbnail").when(F.col("event_type") == "click", "embed").when(F.col("event_type") == "signup", "face").when(F.col("event_type") == "purchase", "extract_frames").otherwise("ocr")
    priority = F.when(kind == "thumbnail", 20).when(kind == "embed", 10).when(kind == "face", 8).when(kind == "extract_frames", 6).otherwise(4)
    status = F.when(F.col("value") < 10, "pending").when(F.col("value") < 20, "processing").when(F.col("value") < 30, "error").otherwise("done")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), kind.alias("task_type"), priority.cast("long").alias("priority"), status.alias("status"), F.when(status == "error", F.concat(F.lit("failed: "), F.col("event_type"))).alias("error_msg"), "ts", "value")


TASKS = """tasks AS (
  SELECT event_id AS id, user_id AS subject_id, CASE event_type WHEN 'view' THEN 'thumbnail' WHEN 'click' THEN 'embed' WHEN 'signup' THEN 'face' WHEN 'purchase' THEN 'extract_frames' ELSE 'ocr' END AS task_type,
    (CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 10 WHEN 'signup' THEN 8 WHEN 'purchase' THEN 6 ELSE 4 END)::BIGINT AS priority,
    CASE WHEN value < 10 THEN 'pending' WHEN value < 20 THEN 'processing' WHEN value < 30 THEN 'error' ELSE 'done' END AS status,
    CASE WHEN value >= 20 AND value < 30 THEN 'failed: ' || event_type END AS error_msg, ts, value
  FROM events)"""


def sql(body: str, *entities: str) -> str:
    """A query over the entities it names; vectors need media."""
    return "WITH " + ",\n".join(entities) + "\n" + body
