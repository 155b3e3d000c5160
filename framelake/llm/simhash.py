"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are compared in tiles with numpy exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius are skipped. To spread the work, fingerprints are first dealt by the
values of bit ranges (band_masks): two fingerprints within the radius agree on at least one mask, so no link is
lost and only fingerprints that share a mask's value are compared. A value with more than HOT fingerprints is split into
tiles by population count and hash; its tile pairs within the radius are tasks of their own. Within a group only the
links of a spanning forest are emitted, never all pairs.

Edge cases: null or empty texts and texts without words have fingerprint zero and are linked like others; fewer
than SHINGLE words make one shingle; repeated rows get one row each; copies meet by their fingerprint before any
comparison; null ids take part but are never a component's number unless all its ids are null.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, slices, stage
from framelake.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in one tile of a hot range value, and from how many on it is hot.
TILE = 1024
HOT = 2 * TILE
#: Fingerprints on either side of one numpy comparison.
SIDE = 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, set_bits = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # long texts in pieces
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : min(n, at + (1 << 14))].tolist(), last[at : at + (1 << 14)].tolist())])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), h (hash of the text); one row per input row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64()), part.column("h")], names=["doc_id", "fp", "h"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, fp long, h long")


def band_masks(radius: int, n: int, most: int = 256) -> list[int]:
    """Bit masks of which any two fingerprints within the radius agree on one at least.

    The 64 bits are cut into m ranges; two fingerprints that differ in at most ``radius`` bits agree on m - radius of
    them. m grows with the number n of fingerprints until a mask's value is expected to be shared by ``most`` at most.
    """
    for m in range(radius + 1, radius + 4):
        cuts = [round(i * 64 / m) for i in range(m + 1)]
        ranges = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        masks = [sum(c) for c in itertools.combinations(ranges, m - radius)]
        if n / 2.0 ** min(mask.bit_count() for mask in masks) <= most:
            break
    return masks


class Forest:
    """Smallest member of each class of linked rows; numbers of rows are their ranks by value."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            odd = x != y
            if not odd.any():
                return
            a, b, x, y = a[odd], b[odd], x[odd], y[odd]
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while True:
                short = self.of[self.of]
                if (short == self.of).all():
                    break
                self.of = short


def links(values: np.ndarray, left: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, smallest value of its class) among distinct int64 fingerprints of one group.

    ``left`` marks the rows of the first tile when the group is a pair of tiles: then only links across count.
    """
    order = np.argsort(values, kind="stable")
    values = values[order]
    bits = values.view(np.uint64)
    weight = np.bitwise_count(bits).astype(np.int16)
    forest = Forest(len(values))
    if left is None:
        sides = [(np.argsort(weight, kind="stable"),) * 2]
    else:
        left = left[order]
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        sides = [(one[np.argsort(weight[one], kind="stable")], two[np.argsort(weight[two], kind="stable")])]
    for rows, columns in sides:
        for i in range(0, len(rows), SIDE):
            a = rows[i : i + SIDE]
            for j in range(i if left is None else 0, len(columns), SIDE):
                b = columns[j : j + SIDE]
                if weight[b[0]] - weight[a[-1]] > radius or weight[a[0]] - weight[b[-1]] > radius:
                    continue  # no pair of these tiles can be within the radius
                x, y = np.nonzero(np.bitwise_count(bits[a][:, None] ^ bits[b][None, :]) <= radius)
                if len(x):
                    forest.link(a[x], b[y])
    at = np.flatnonzero(forest.of != np.arange(len(values)))
    return values[at], values[forest.of[at]]


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links within each group of ``rows`` (grp long, part int, fp long); groups are contiguous in sorted partitions.

    part -1: compare the whole group; 0 and 1: the two tiles of a pair. A group is held in memory, HOT rows at most.
    """

    def flush(grp: np.ndarray, part: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.diff(grp)) + 1
        out = []
        for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(grp)]])):
            if e - s > 1:
                out.append(links(fp[s:e], None if part[s] < 0 else part[s:e] == 0, radius))
        return out

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            found = flush(*(h[:cut] for h in held)) if cut else []
            held = [h[cut:] for h in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], names=["u", "v"])
        found = flush(*held) if len(held[0]) else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], names=["u", "v"])

    dealt = rows.repartition(F.col("grp")).sortWithinPartitions("grp")
    return dealt.select("grp", "part", "fp").mapInArrow(run, "u long, v long")


def near_links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints ``fp`` within the radius of one another."""
    masks = [mask - (1 << 64) if mask >> 63 else mask for mask in band_masks(radius, distinct.count())]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks)))
    banded = distinct.select("fp", F.explode(keys).alias("grp"))
    # tiles of hot groups: by population count, and by hash where one count has more than TILE fingerprints
    sizes = banded.groupBy("grp", F.bit_count("fp").alias("pop")).agg(F.count("*").alias("n"))
    hot = sizes.groupBy("grp").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))).alias("tiles")).where(F.col("all") > HOT)
    hot = stage(spark, hot.drop("all"), "hot")
    if hot.isEmpty():
        return _compare(banded.select("grp", F.lit(-1).alias("part"), "fp"), radius)
    cold = banded.join(hot, "grp", "left_anti").select("grp", F.lit(-1).alias("part"), "fp")
    own = F.bit_count("fp")
    mine = banded.join(hot, "grp").withColumn("pop", own).withColumn("tile", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("tiles")[F.col("pop")]).cast("int"))
    near = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("pop")) <= radius)
    other = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda t: F.struct(e["key"].alias("pop"), t.alias("tile")))))
    pairs = mine.select("grp", "fp", F.struct("pop", "tile").alias("me"), F.explode(other).alias("it"))
    tiled = pairs.select(
        F.xxhash64("grp", F.least("me", "it"), F.greatest("me", "it")).alias("grp"),
        F.when(F.col("me") == F.col("it"), -1).when(F.col("me") < F.col("it"), 0).otherwise(1).alias("part"),
        "fp",
    )
    return _compare(cold.unionByName(tiled), radius)


def _grouped(spark: SparkSession, docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, h, root (a component's smallest fingerprint), component_id (its smallest id); one row per input row."""
    rows = stage(spark, fingerprints(docs), "fingerprints")
    first = stage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    roots = stage(spark, components(spark, near_links(spark, first.select("fp"), radius)), "roots")
    linked = roots.join(first, roots.node == first.fp).select("fp", "root", "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    # written first: the rows that join it can then be split where one fingerprint has very many copies
    every = stage(spark, first.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "doc").alias("component_id")), "components")
    return rows.join(every, "fp")


def cluster(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id; one row per input row."""
    return _grouped(spark, docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each component: that of its smallest id.

    Rows that share an id but not a text are separate documents: each component keeps its own, of several texts with its
    smallest id that of the smallest hash. Rows with a null id are told apart by their text; a component keeps one of
    them only if it has no row with an id. Of repeated rows one stays.
    """
    names = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_h": F.xxhash64("text")}
    taken = {c.lower() for c in docs.columns}
    names = {next(n + "_" * i for i in range(99) if n + "_" * i not in taken): c for n, c in names.items()}
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("k")
    keep = stage(spark, _grouped(spark, docs, radius).groupBy("root").agg(first).select(*[F.col(f"k.{c}").alias(n) for c, n in zip(("none", "id", "h"), names)]), "kept")
    rows = docs.select("*", *[c.alias(n) for n, c in names.items()])
    return rows.join(keep, list(names), "left_semi").dropDuplicates(list(names)).drop(*names)
