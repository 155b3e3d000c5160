"""Work queue: counts, rows, transitions, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Priorities by task.
PRIORITY = {"thumbnail": 20, "embed": 10, "face": 8, "extract_frames": 6, "ocr": 4}
NOT_READY = "Embedding model not ready"
STATES = ("pending", "processing", "done", "error")


def stats(tasks: DataFrame) -> DataFrame:
    """One row of counts by state; zeros for an empty queue."""
    return tasks.agg(*[F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s) for s in STATES])


def counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type", "status").agg(F.count("*").alias("n"))


def counts_map(tasks: DataFrame) -> DataFrame:
    """One map a task type: state -> number."""
    pairs = F.array_sort(F.collect_list(F.struct("status", "n")))
    return counts(tasks).groupBy("task_type").agg(F.map_from_entries(pairs).alias("counts"))


def order():
    """What runs now, then by priority, then by age."""
    return [F.desc(F.col("status") == "processing"), F.desc("priority"), F.asc("id")]


def rows(tasks: DataFrame, media: DataFrame, videos: DataFrame, status: list[str], limit: int) -> DataFrame:
    """Tasks with the name and kind of what they are about: a video for extract_frames, else a photo."""
    top = tasks.where(F.col("status").isin(status)).orderBy(*order()).limit(limit)
    is_video = F.col("task_type") == "extract_frames"
    p = media.select(F.col("id").alias("p_id"), F.col("file_name").alias("p_name"), F.col("kind").alias("p_kind"))
    v = videos.select(F.col("id").alias("v_id"), F.col("file_name").alias("v_name"), F.col("kind").alias("v_kind"))
    out = top.join(p, ~is_video & (F.col("subject_id") == F.col("p_id")), "left").join(v, is_video & (F.col("subject_id") == F.col("v_id")), "left")
    return out.select("id", "task_type", "status", "priority", F.coalesce(F.when(is_video, F.col("v_name")).otherwise(F.col("p_name")), F.lit("")).alias("name"), F.when(is_video, F.coalesce("v_kind", F.lit("video"))).otherwise(F.col("p_kind")).alias("kind"), "error_msg")


def next_task(tasks: DataFrame, kind: str | None = None) -> DataFrame:
    rows = tasks.where("status = 'pending'")
    return (rows.where(F.col("task_type") == kind) if kind else rows).orderBy(F.desc("priority"), "id").limit(1)


def schedule(tasks: DataFrame, paused: list[str], urgent: str = "urgent", limit: int = 50) -> DataFrame:
    """What runs next: pending tasks of kinds that aren't paused; urgent ones (a boolean column) jump ahead of all others."""
    rows = tasks.where((F.col("status") == "pending") & ~F.col("task_type").isin(paused))
    return rows.orderBy(F.desc(F.coalesce(F.col(urgent), F.lit(False))), F.desc("priority"), "id").limit(limit)


def fold(events: DataFrame) -> DataFrame:
    """Latest state of each task from a log of (id, status, error_msg, ts, seq); retries are counted."""
    last = F.max_by(F.struct("status", "error_msg"), F.struct("ts", "seq"))
    return events.groupBy("id").agg(last.alias("s"), F.count_if(F.col("status") == "error").alias("retries"), F.max("ts").alias("updated_at")).select("id", "s.*", "retries", "updated_at")


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks that were running when the process ended wait again."""
    return tasks.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def retried(tasks: DataFrame, ids_json: str | None = None) -> DataFrame:
    """Failed tasks wait again: those of a JSON list of ids, or all."""
    chosen = F.lit(True) if ids_json is None else F.array_contains(F.from_json(F.lit(ids_json), "array<bigint>"), F.col("id"))
    hit = (F.col("status") == "error") & chosen
    return tasks.withColumn("error_msg", F.when(~hit, F.col("error_msg"))).withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def without_recoverable_errors(tasks: DataFrame) -> DataFrame:
    return tasks.where(~((F.col("status") == "error") & F.coalesce(F.col("error_msg").startswith(NOT_READY), F.lit(False))))


def pruned(tasks: DataFrame, keep_done: int) -> DataFrame:
    """All that isn't done, and the newest done tasks."""
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("id")))
    done = tasks.where("status = 'done'").withColumn("r", rank).where(F.col("r") <= keep_done).drop("r")
    return tasks.where("status <> 'done'").unionByName(done)


def missing_vectors(media: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live contents without a vector, by their smallest id."""
    live = media.where("not deleted and kind = 'image'").groupBy("file_hash").agg(F.min("id").alias("id"))
    return live.join(vectors.select("file_hash"), "file_hash", "left_anti").select("id", "file_hash")


def unscanned_videos(videos: DataFrame, segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Videos of known length without segments and without an open task. Null subjects never exclude a video."""
    open_ = tasks.where("task_type = 'extract_frames' and status in ('pending', 'processing') and subject_id is not null").select(F.col("subject_id").alias("id"))
    known = videos.where("duration_ms is not null and not deleted")
    return known.join(segments.select(F.col("video_id").alias("id")), "id", "left_anti").join(open_, "id", "left_anti").select("id")


def requeue(media: DataFrame, vectors: DataFrame, videos: DataFrame, segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """New tasks (subject_id, task_type, priority) for all that is missing."""
    new = lambda df, kind: df.select(F.col("id").alias("subject_id"), F.lit(kind).alias("task_type"), F.lit(PRIORITY[kind]).alias("priority"))
    return new(missing_vectors(media, vectors), "embed").unionByName(new(unscanned_videos(videos, segments, tasks), "extract_frames"))
