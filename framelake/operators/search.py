"""Relevance gate, rank fusion and the four-channel search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.vector import dot, literal
from framelake.operators import textsearch, vectors as V
from framelake.operators.browse import date_filter, representatives

#: Fixed values of the relevance gate.
MIN_Z, MIN_ROBUST_Z, ROBUST_BELOW, MIN_SAMPLE, SAMPLE = 2.75, 3.5, 150, 20, 256
RRF_K = 60
FALLBACK = 12
SIMILAR_FLOOR = 0.85
CHANNELS = ("visual", "segment", "text", "filename")


def baseline(vectors: DataFrame, id: str, value: str = "embedding") -> DataFrame:
    """A reproducible sample of SAMPLE vectors, or of their cosines to a query, in hash order."""
    return vectors.select(F.col(id).alias("sample_id"), value).orderBy(F.md5(F.col(id).cast("string").cast("binary")), id).limit(SAMPLE)


def sketch(vectors: DataFrame, id: str) -> DataFrame:
    """The sample with what its upkeep needs: (sample_id, embedding, h, n): the SAMPLE least hashes of n vectors."""
    h = F.md5(F.col(id).cast("string").cast("binary"))
    one = vectors.select(F.col(id).cast("string").alias("sample_id"), "embedding", h.alias("h")).orderBy("h", "sample_id").limit(SAMPLE)
    return one.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))  # one row


def merged_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of two disjoint sets of vectors from theirs; no vector but the samples' is read."""
    n = a.select("n").limit(1).unionByName(b.select("n").limit(1)).agg(F.sum("n").alias("n"))
    both = a.drop("n").unionByName(b.drop("n")).orderBy("h", "sample_id").limit(SAMPLE)
    return both.crossJoin(F.broadcast(n))  # one row


def stale(sketched: int, now: int) -> bool:
    """Whether a sketch of that many vectors no longer stands for the present number."""
    return abs(now - sketched) > max(10, 0.1 * sketched)


def gate_stats(sample: DataFrame, query: list[float] | None) -> DataFrame:
    """One row: n, mean, sd (population), median (upper), mad of the cosines of a sample of at most SAMPLE vectors; without a query
    the sample has a column ``cosine``."""
    sims = F.sort_array(F.collect_list("s"))
    cosine = F.col("cosine") if query is None else dot(F.col("embedding"), literal(query))
    one = sample.select(cosine.alias("s")).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), sims.alias("sims"))
    middle = lambda a: F.get(a, (F.col("n") / 2).cast("int"))
    one = one.withColumn("median", middle(F.col("sims")))
    return one.select("n", "mean", "sd", "median", middle(F.sort_array(F.transform("sims", lambda x: F.abs(x - F.col("median"))))).alias("mad"))


def relevant(cosine: Column) -> Column:
    """Whether a hit stands out from the sample whose statistics stand in the same row."""
    c = F.col
    z = (cosine - c("mean")) / F.when(c("sd") > 0, c("sd")).otherwise(1e-6)
    robust = (cosine - c("median")) / (1.4826 * F.when(c("mad") > 0, c("mad")).otherwise(1e-6))
    return (c("n") < MIN_SAMPLE) | (z >= MIN_Z) | ((c("n") < ROBUST_BELOW) & (robust >= MIN_ROBUST_Z))


def gated(hits: DataFrame, sample: DataFrame, query: list[float] | None = None) -> DataFrame:
    """Hits with a column ``passed``; sample and query as for ``gate_stats``."""
    stats = gate_stats(sample, query)
    return hits.crossJoin(F.broadcast(stats)).withColumn("passed", relevant(F.col("cosine"))).select(*hits.columns, "passed")  # one row


def pooled_sample(own: DataFrame, other: DataFrame) -> DataFrame:
    """The own kind's sample if it has MIN_SAMPLE vectors, else both kinds'. Samples have SAMPLE rows at most."""
    count = own.agg((F.count("*") < MIN_SAMPLE).alias("few"))
    borrowed = other.crossJoin(F.broadcast(count)).where("few").drop("few")  # one row
    return own.unionByName(borrowed)


def rrf(ranked: DataFrame, item: str = "file_hash", k: int = RRF_K, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of rows (channel, item, rank from 0): score and first place by item.

    Repeats of an item within one channel add again. ``first`` orders ties by channel, then rank. ``extra`` are further
    aggregates by item.
    """
    return ranked.groupBy(item).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("channel", "rank")).alias("first"), *extra)


def fusion_order(item: str = "file_hash") -> list[Column]:
    return [F.desc(F.round("score", 12)), F.asc("first"), F.asc(item)]


def tags(channels: Column, names: tuple[str, ...] = CHANNELS) -> Column:
    """Names of the channels in a set of channel numbers, in fixed order."""
    return F.filter(F.array(*[F.when(F.array_contains(channels, i), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


@dataclass
class Library:
    """media (see plans.entities), vectors (file_hash, embedding), segments, texts (file_hash, text; copies may repeat), and the
    texts' index if there is one.

    Where vectors and segments come from joins or windows, ``scored`` gives both for a query, with ``cosine`` in place of
    ``embedding``, so that no vector is shuffled."""

    media: DataFrame
    vectors: DataFrame
    segments: DataFrame
    texts: DataFrame
    index: textsearch.TextIndex | None = None
    scored: Callable[[list[float]], tuple[DataFrame, DataFrame]] | None = None

    def cosines(self, query: list[float]) -> tuple[DataFrame, DataFrame]:
        """Vectors and segments with their cosines to a query."""
        return self.scored(query) if self.scored else (V.scored(self.vectors, query), V.scored(self.segments, query))


@dataclass
class Query:
    text: str
    vector: list[float] | None = None
    limit: int = 50
    kind: str | None = None
    folder_id: int | None = None
    date_from: str | None = None
    date_to: str | None = None


def channels(lib: Library, q: Query) -> DataFrame:
    """Rows (channel, file_hash, rank, passed, start_ms, end_ms) of all channels that the kind leaves.

    Every channel has 2 * limit rows at most, so all that follows is small.
    """
    wide, parts = 2 * q.limit, []
    span = [F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms")]
    if q.vector:
        vectors, segments = lib.cosines(q.vector)
        images, pieces = baseline(vectors, "file_hash", "cosine"), baseline(segments, "segment_id", "cosine").withColumn("sample_id", F.col("sample_id").cast("string"))
    if q.vector and q.kind != "audio":
        hits = gated(V.closest(vectors, wide, ["file_hash"]), pooled_sample(images, pieces))
        parts.append(hits.select(F.lit(0).alias("channel"), "file_hash", "rank", "passed", *span))
    if q.vector and q.kind != "image":
        near = V.best_per_video(V.closest(segments, wide, ["segment_id", "video_id", "start_ms", "end_ms"]))
        near = gated(near, pooled_sample(pieces, images))
        frames = lib.media.where("not deleted and video_id is not null").groupBy("video_id").agg(F.min_by("file_hash", "id").alias("file_hash"))
        near = near.join(frames, "video_id")
        # several videos may share a frame: the closest segment speaks for it
        near = near.groupBy("file_hash").agg(F.max_by(F.struct("cosine", "passed", "start_ms", "end_ms"), F.struct("cosine", -F.col("segment_id"))).alias("b")).select("file_hash", "b.*")
        rank = F.row_number().over(Window.orderBy(F.desc("cosine"), "file_hash")) - 1
        parts.append(near.select(F.lit(1).alias("channel"), "file_hash", rank.alias("rank"), "passed", "start_ms", "end_ms"))
    always = F.lit(True).alias("passed")
    if q.kind != "audio":
        one = lib.texts.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(q.text).alias("text"))
        found = lib.index.search(one, wide) if lib.index else textsearch.bm25(lib.texts, one, wide)
        parts.append(found.select(F.lit(2).alias("channel"), "file_hash", "rank", always, *span))
    named = textsearch.by_file_name(lib.media, q.text, wide)
    rank = F.row_number().over(Window.orderBy("id")) - 1
    parts.append(named.select(F.lit(3).alias("channel"), "file_hash", rank.alias("rank"), always, *span))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _of_hits(media: DataFrame, hits: DataFrame) -> DataFrame:
    """Representatives of the contents found (a few hundred at most, so they are broadcast), not of the whole catalogue."""
    return representatives(media.join(F.broadcast(hits.select("file_hash")), "file_hash", "left_semi"))


def search(lib: Library, q: Query) -> DataFrame:
    """Fused results: file_hash, id, kind, score (1 for the best before filters), matched_by, start_ms, end_ms, low_confidence, rank.

    An empty text browses instead: filtered representatives, newest first, score 1. A text with nothing that stands out
    in any channel gives FALLBACK nearest hits, marked low_confidence.
    """
    if not q.text.strip():
        return _browse(lib, q)
    # windows over the few candidates rather than joins, so that the channels are computed once
    everything = Window.partitionBy(F.lit(1))
    found = channels(lib, q).withColumn("low_confidence", F.max(F.col("passed").cast("int")).over(everything) == 0)
    found = found.where(F.col("passed") | (F.col("low_confidence") & (F.col("rank") < FALLBACK)))
    # contents that a segment stands for leave the image channel, or the video would count twice
    in_segments = F.max((F.col("channel") == 1).cast("int")).over(Window.partitionBy("file_hash"))
    found = found.withColumn("in_segments", in_segments).where("channel <> 0 or in_segments = 0")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy("rank")) - 1)
    extra = (F.collect_set("channel").alias("set"), F.max("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("low_confidence").alias("low_confidence"))
    fused = rrf(found, extra=extra).withColumn("score", F.col("score") / F.max("score").over(everything))
    out = fused.join(_of_hits(lib.media, fused).select("file_hash", "id", "kind", "video_id", "taken_at"), "file_hash")
    if q.folder_id is not None:
        inside = lib.media.where(~F.col("deleted") & (F.col("folder_id") == q.folder_id)).select("file_hash")
        out = out.join(inside, "file_hash", "left_semi")
    if q.date_from or q.date_to:
        out = out.where(date_filter(F.col("taken_at"), q.date_from, q.date_to, "keep"))
    if q.kind:
        out = out.where(F.col("kind") == q.kind)
    owner = F.coalesce(F.concat(F.lit("v"), F.col("video_id").cast("string")), F.concat(F.lit("h"), F.col("file_hash")))
    out = out.withColumn("turn", F.row_number().over(Window.partitionBy(owner).orderBy(*fusion_order()))).where("turn = 1")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*fusion_order())) - 1)
    out = out.where(F.col("rank") < F.when(F.col("low_confidence"), F.lit(min(q.limit, FALLBACK))).otherwise(F.lit(q.limit)))
    return out.select("file_hash", "id", "kind", "score", F.array_join(tags(F.col("set")), ",").alias("matched_by"), "start_ms", "end_ms", "low_confidence", "rank")


def _browse(lib: Library, q: Query) -> DataFrame:
    from framelake.operators.browse import filtered

    rows = filtered(lib.media, q.kind, q.folder_id, q.date_from, q.date_to)
    order = [F.desc("taken_at"), F.desc("created_at"), F.asc("id")] if q.kind or q.folder_id is not None or q.date_from or q.date_to else [F.desc("created_at"), F.asc("id")]
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    none = F.lit(None).cast("long")
    return rows.orderBy(*order).limit(q.limit).select("file_hash", "id", "kind", F.lit(1.0).alias("score"), F.lit("").alias("matched_by"), none.alias("start_ms"), none.alias("end_ms"), F.lit(False).alias("low_confidence"), rank.alias("rank"))


def similar(lib: Library, query: list[float], skip_hash: str, limit: int = 12, least: float = SIMILAR_FLOOR) -> DataFrame:
    """Contents at least that close to a given one, live, one row a video; 3 * limit candidates, so filters may under-fill."""
    near = V.closest(lib.cosines(query)[0], 3 * limit + 1, ["file_hash"]).where((F.col("file_hash") != skip_hash) & (F.col("cosine") >= least))
    out = near.join(_of_hits(lib.media, near).select("file_hash", "id", "kind", "video_id"), "file_hash")
    owner = F.coalesce(F.concat(F.lit("v"), F.col("video_id").cast("string")), F.concat(F.lit("h"), F.col("file_hash")))
    out = out.withColumn("turn", F.row_number().over(Window.partitionBy(owner).orderBy("rank"))).where("turn = 1")
    return out.orderBy("rank").limit(limit).select("file_hash", "id", "kind", "cosine")
