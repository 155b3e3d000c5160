"""Changes of state as pure functions: tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with equal keys; both have one row a key.

    Columns in ``keep_if_null`` keep the old value where the new one is null (partial update); columns in ``keep``
    always keep it (assignments that survive); all others are overwritten, by nulls too.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new, is_old = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys]), F.coalesce(*[F.col(f"o.{k}").isNotNull() for k in keys])

    def value(c: str):
        if c not in new.columns or c in keep:
            fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
            return F.when(is_old, F.col(f"o.{c}")).otherwise(fresh).alias(c)
        fresh = F.coalesce(f"n.{c}", f"o.{c}") if c in keep_if_null else F.col(f"n.{c}")
        return F.when(is_new, fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def soft_deleted(media: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose path is in ``gone`` (file_path) become deleted."""
    mark = gone.select("file_path").distinct().withColumn("gone", F.lit(True))
    return media.join(mark, "file_path", "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).select(media.columns)


def missing_paths(media: DataFrame, listing: DataFrame) -> DataFrame:
    """Live paths that a listing of the sources no longer has."""
    return media.where("not deleted").join(listing, "file_path", "left_anti").select("file_path")


def known_paths(asked: DataFrame, media: DataFrame, folders: DataFrame) -> DataFrame:
    """Of the paths that are asked for (file_path), those of the catalogue's files or folders: only they may be opened."""
    known = media.select("file_path").unionByName(folders.select(F.col("path").alias("file_path")))
    return asked.join(known, "file_path", "left_semi")


def changed_files(media: DataFrame, listing: DataFrame, thumbnails: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Listed files (file_path, file_size, mtime, folder_id, ...) that need work: those without a live row that agrees in all of
    path, size, time of change and folder, and has a hash.

    With ``thumbnails`` (file_hash) and ``tasks`` (subject_id, task_type, status) a known file also needs work if its content
    has no thumbnail and no task for one is open or has failed; a failed one waits for its user.
    """
    known = media.where(~F.col("deleted") & F.col("file_hash").isNotNull())
    if thumbnails is not None and tasks is not None:
        waiting = tasks.where((F.col("task_type") == "thumbnail") & F.col("status").isin("pending", "processing", "error")).select(F.col("subject_id").alias("id"))
        done = known.join(thumbnails.select("file_hash"), "file_hash", "left_semi").select("id").unionByName(known.join(waiting, "id", "left_semi").select("id"))
        known = known.join(done, "id", "left_semi")
    same = ["file_path", "file_size", "mtime", "folder_id"]
    k = known.select(*[F.col(c).alias(f"k_{c}") for c in same])
    agree = [F.col("file_path") == F.col("k_file_path"), F.col("file_size") == F.col("k_file_size"), F.col("mtime") == F.col("k_mtime"), F.col("folder_id").eqNullSafe(F.col("k_folder_id"))]
    return listing.join(k, agree, "left_anti")


def orphans(media: DataFrame, folder_id: int) -> DataFrame:
    """Hashes of a folder that no live row elsewhere has."""
    mine = media.where(F.col("folder_id") == folder_id).select("file_hash").distinct()
    elsewhere = media.where((F.col("folder_id") != folder_id) & ~F.col("deleted")).select("file_hash")
    return mine.join(elsewhere, "file_hash", "left_anti")


def folder_removed(media: DataFrame, tasks: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media, tasks and orphaned hashes after a folder is removed; a task goes only with a subject of its own type."""
    ids = media.where(F.col("folder_id") == folder_id).select(F.col("id").alias("subject_id"))
    photo_tasks = tasks.where("task_type <> 'extract_frames'").join(ids, "subject_id", "left_anti").select(tasks.columns)
    return media.where((F.col("folder_id") != folder_id) | F.col("folder_id").isNull()), photo_tasks.unionByName(tasks.where("task_type = 'extract_frames'")), orphans(media, folder_id)


def folder_videos_removed(videos: DataFrame, segments: DataFrame, tasks: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos, segments with their vectors, and tasks after a folder is removed: its videos go with their segments and frame tasks;
    a task of another type with an equal number stays."""
    gone = videos.where(F.col("folder_id") == folder_id).select(F.col("id").alias("video"))
    left = videos.where((F.col("folder_id") != folder_id) | F.col("folder_id").isNull())
    mine = (F.col("task_type") == "extract_frames") & (F.col("subject_id") == F.col("video"))
    return left, segments.join(gone, F.col("video_id") == F.col("video"), "left_anti"), tasks.join(gone, mine, "left_anti")


def saved_vectors(media: DataFrame, mapped: DataFrame, vectors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media, map (file_hash, vec_id) and vectors (vec_id, embedding) with the vectors ``new`` (file_hash, vec_id, embedding; one row
    a hash): a hash that is mapped keeps its number, whose vector is replaced; all live rows of the hashes become ``done``.

    The three belong together: write them as one version (``Versions.write``).
    """
    known = mapped.withColumnRenamed("vec_id", "known")
    placed = new.join(known, "file_hash", "left").select("file_hash", F.coalesce("known", "vec_id").alias("vec_id"), "embedding")
    fresh = placed.join(mapped.select("file_hash"), "file_hash", "left_anti").select(mapped.columns)
    has = new.select("file_hash", F.lit(True).alias("has"))
    status = F.when(F.col("has") & ~F.col("deleted"), "done").otherwise(F.col("status"))
    out = media.join(has, "file_hash", "left").withColumn("status", status).select(media.columns)
    return out, mapped.unionByName(fresh), upsert(vectors, placed.select("vec_id", "embedding"), ["vec_id"])


def saved_segments(segments: DataFrame, mapped: DataFrame, vectors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, map (segment_id, vec_id) and vectors (vec_id, embedding) with ``new`` (the columns of segments, vec_id, embedding; one
    row a segment). Segments of known numbers are replaced and keep their vector's number. To be written as one version too."""
    placed = new.join(mapped.withColumnRenamed("vec_id", "known"), "segment_id", "left").withColumn("vec_id", F.coalesce("known", "vec_id"))
    fresh = placed.join(mapped.select("segment_id"), "segment_id", "left_anti").select(mapped.columns)
    return upsert(segments, new.select(segments.columns), ["segment_id"]), mapped.unionByName(fresh), upsert(vectors, placed.select("vec_id", "embedding"), ["vec_id"])


def repaired_vectors(media: DataFrame, mapped: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media with their status and the map of hashes to vectors, made to agree with the vectors that exist.

    Map rows (file_hash, vec_id) without a vector or without a live file go; live rows whose content then has no map row go back
    from ``done`` to ``pending``, and copies of a content that has one become ``done``.
    """
    live = media.where(~F.col("deleted")).select("file_hash").distinct()
    kept = mapped.join(vectors.select("vec_id"), "vec_id", "left_semi").join(live, "file_hash", "left_semi").select(mapped.columns)
    has = kept.select("file_hash", F.lit(True).alias("has")).distinct()
    status = F.when(F.col("deleted"), F.col("status")).when(F.col("has"), "done").when(F.col("status") == "done", "pending").otherwise(F.col("status"))
    return media.join(has, "file_hash", "left").withColumn("status", status).select(media.columns), kept


def collected(content: DataFrame, media: DataFrame) -> DataFrame:
    """Content rows (vectors, texts, faces; keyed by file_hash) that a live row still refers to."""
    return content.join(media.where("not deleted").select("file_hash"), "file_hash", "left_semi").select(content.columns)


def video_removed(media: DataFrame, video_id: int) -> DataFrame:
    """The video and its frames become deleted."""
    return media.withColumn("deleted", F.col("deleted") | F.coalesce(F.col("video_id") == video_id, F.lit(False)))


def versioned_reset(content: DataFrame, have: str | None, want: str) -> DataFrame:
    """Nothing is left when the version of the pipeline that made it differs."""
    return content if have == want else content.where(F.lit(False))


def rescan(media: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """Hashes of video frames that show no named person."""
    named = faces.join(people.where("name is not null and name <> ''").select("person_id"), "person_id", "left_semi").select(F.col("face_id").alias("id"))
    shown = media.join(named, "id", "left_semi").select("file_hash")
    return media.where("video_id is not null and not deleted").select("file_hash").distinct().join(shown, "file_hash", "left_anti")
