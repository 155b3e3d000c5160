"""Substring deduplication by relative Lempel-Ziv parsing.

Removed is every word covered by a WINDOW of consecutive words whose word sequence also starts in a document with
a smaller id. The reference is the corpus itself, in order of ids, cut into blocks: each window names, by its smallest
word k-gram hash, one anchor; a block is an anchor with the run of windows that name it and all their words. Of
blocks with equal words the first is the indexed one: its place (document, word) stands for all of them. Equal windows
name equal anchors, so every earlier occurrence of a window lies in an indexed block of the same anchor, and each
document is parsed against all indexed blocks that share an anchor with it, wherever in the corpus they are:

1. Documents that repeat an earlier one whole are a single factor.
2. Each block of the others is looked up as a whole; a hit gives the place of the earlier block for all its windows.
3. Where blocks of one anchor differ, the block's windows are looked up one by one among the windows of all differing
   blocks of that anchor (128-bit hashes); a hit gives the place of the first such window.
4. ``factors`` parses the document greedily, from left to right: from the first window that has a place on, the factor
   goes on for as long as the next window's place is the next word of the same document; the next factor starts with
   the first window after it. Windows that straddle two factors are windows like others, so nothing at a factor's
   boundary is missed. Factors are WINDOW words or longer; the union of their words is removed.

Only anchors that two documents share leave step 1, only distinct blocks reach step 3, and all first occurrences are
minima that are combined before the shuffle, so a passage in a third of all documents makes no group that one task must
hold. Texts are told apart by id and hash, so many rows without an id, or with one, are no larger join.

Edge cases: null and empty texts have no words; texts of fewer words than a window lose nothing; null ids count as
larger than all others; rows with equal ids never remove words of each other; repeated rows get one row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Staged, slices, stage

WINDOW = 50
GRAM = 16
LAST = 2**63 - 1
#: Bits of the filter before a join.
FILTER_BITS = 2**24
FACTORS = "array<struct<start:int,length:int,ref_id:bigint,ref_hash:bigint,ref_start:int>>"
#: Odd multipliers of the two rolling hashes (64-bit).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << n.bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _powers[base] = (out[0], out[1])
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a text and hashes of any run of them."""

    def __init__(self, text: str | None):
        import xxhash

        self.words = text.encode("utf-8", "replace").split() if text else []
        self.n = len(self.words)
        if self.n >= WINDOW:
            digest = xxhash.xxh64_digest
            self.codes = np.frombuffer(b"".join([digest(w) for w in self.words]), np.uint64)
        self._sums: dict[int, np.ndarray] = {}

    def runs(self, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
        """Hash of the words from start to stop, equal for equal runs wherever they start."""
        power, inverse = _power(base, self.n + 1)
        if base not in self._sums:
            self._sums[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes * power[: self.n], dtype=np.uint64)])
        sums = self._sums[base]
        return _mixed((sums[stop] - sums[start]) * inverse[start])

    def digest(self, keep: np.ndarray | None = None) -> str:
        words = self.words if keep is None else [w for w, k in zip(self.words, keep.tolist()) if k]
        return hashlib.sha256(b" ".join(words)).hexdigest()

    def blocks(self) -> tuple[np.ndarray, ...]:
        """anchor, block hash, first and last window start of each block."""
        starts = np.arange(self.n - GRAM + 1)
        grams = self.runs(starts, starts + GRAM, BASES[0])
        width = WINDOW - GRAM + 1
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        named = np.concatenate([np.argmin(view[i : i + 8192], axis=1) for i in range(0, len(view), 8192)]) + np.arange(len(view))
        first = np.concatenate([[0], np.flatnonzero(np.diff(named)) + 1])
        last = np.concatenate([first[1:] - 1, [len(view) - 1]])
        at = named[first]
        body = self.runs(first, last + WINDOW, BASES[1])
        shape = ((at - first) * 64 + (last - first)).astype(np.uint64)
        return grams[at].view(np.int64), _mixed(body + shape * np.uint64(BASES[0])).view(np.int64), first.astype(np.int32), last.astype(np.int32)


def _parsed(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        for batch in batches:
            for part in slices(batch):
                texts = [Words(t) for t in part.column("text").to_pylist()]
                blocks = [w.blocks() if w.n >= WINDOW else none for w in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array([w.n for w in texts], pa.int64()), pa.array([w.digest() for w in texts], pa.string()), *(pa.array([b[i] for b in blocks], k) for i, k in enumerate((longs, longs, ints, ints)))],
                    names=["doc_id", "t", "n_words", "digest", "a", "b", "s", "e"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, t long, n_words long, digest string, a array<bigint>, b array<bigint>, s array<int>, e array<int>")


def _windows(texts: DataFrame) -> DataFrame:
    """One row for each window to look up: w1, w2, key, t, s."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 64):
                for key, t, text, asked in zip(*(part.column(c).to_pylist() for c in ("key", "t", "text", "asked"))):
                    if not asked:
                        continue
                    words = Words(text)
                    at = np.unique(np.concatenate([np.arange(r["s"], r["e"] + 1) for r in asked]))
                    w = [words.runs(at, at + WINDOW, base).view(np.int64) for base in BASES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[0], pa.int64()), pa.array(w[1], pa.int64()), pa.array(np.full(len(at), key), pa.int64()), pa.array(np.full(len(at), t), pa.int64()), pa.array(at.astype(np.int32), pa.int32())],
                        names=["w1", "w2", "key", "t", "s"],
                    )

    return texts.select("key", "t", "text", "asked").mapInArrow(run, "w1 long, w2 long, key long, t long, s int")


def factors(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The greedy parse: (first word, words, document, hash, word) of each factor, from hits in any order.

    A hit is (first window, last window, document, hash, word): windows from first to last have their places from that
    word of that document on. Each window is in one block, so hits don't overlap.
    """
    out: list[list[int]] = []
    for s, e, *place in sorted(found):
        if out and s == out[-1][1] + 1 and place[:2] == out[-1][2:4] and place[2] == out[-1][4] + s - out[-1][0]:
            out[-1][1] = e
        else:
            out.append([s, e, *place])
    return [(s, e - s + WINDOW, d, h, at) for s, e, d, h, at in out]


def _removed(texts: DataFrame) -> DataFrame:
    """key, t, n_removed, kept_sha256, spans and factors from texts with their hits (``whole`` blocks, ``single`` windows)."""
    schema = "key long, t long, n_removed long, kept_sha256 string, spans array<string>, factors " + FACTORS

    def run(batches):
        import pyarrow as pa

        names = ["start", "length", "ref_id", "ref_hash", "ref_start"]
        parts = pa.list_(pa.struct([(n, pa.int64() if n in ("ref_id", "ref_hash") else pa.int32()) for n in names]))
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for key, t, text, whole, single in zip(*(part.column(c).to_pylist() for c in ("key", "t", "text", "whole", "single"))):
                    words = Words(text)
                    edge = np.zeros(words.n + 1, np.int64)
                    parse = factors([(r["s"], r["e"], r["p"]["key"], r["p"]["t"], r["p"]["s"]) for r in whole or []] + [(r["s"], r["s"], r["p"]["key"], r["p"]["t"], r["p"]["s"]) for r in single or []])
                    for s, n, *_ in parse:
                        edge[s] += 1
                        edge[s + n] -= 1
                    gone = np.cumsum(edge)[: words.n] > 0
                    cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    rows.append((key, t, int(gone.sum()), words.digest(~gone), [f"{s}:{e}" for s, e in zip(cuts[::2], cuts[1::2])], [dict(zip(names, f)) for f in parse]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), parts))],
                    names=["key", "t", "n_removed", "kept_sha256", "spans", "factors"],
                )

    return texts.select("key", "t", "text", "whole", "single").mapInArrow(run, schema)


def _wanted(rows: DataFrame, keys: list[str], by: DataFrame) -> DataFrame:
    """``rows`` less most of those that ``by`` has no partner for: what a join with it needs not shuffle.

    A bit for each hash value modulo FILTER_BITS; the broadcast table has FILTER_BITS / 64 rows at most, whatever the
    input. Where it fills up it lets more through, which changes no result.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    bits = by.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_at", at).withColumn("_slot", F.shiftright("_at", 6)).join(F.broadcast(bits), "_slot")
    return marked.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_at", "_slot", "_bits")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans ("start:end" word offsets of what is removed), factors; a row per row.

    A factor names the words of the document, and the document (id, and hash of its text) and word that they repeat; a
    null id is 2 ** 63 - 1.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    parsed = stage(spark, _parsed(docs).withColumn("key", key), "parsed")
    long = parsed.where(F.col("n_words") >= WINDOW)
    # one text for each sequence of words, of the smallest id: (key, t) names it
    firsts = stage(spark, long.groupBy("digest").agg(F.min(F.struct("key", "t")).alias("f")).select("digest", F.col("f.key").alias("first"), F.col("f.t").alias("first_t")), "firsts")
    leading = long.join(firsts, "digest").where("key = first and t = first_t")
    blocks = leading.select("key", "t", F.explode(F.arrays_zip("a", "b", "s", "e")).alias("x")).select("key", "t", "x.*")
    shared = blocks.groupBy("a").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), (F.min("b") != F.max("b")).alias("differ")).where("lo < hi")
    shared = Staged(spark, shared.select("a", "differ"), "shared")
    blocks = Staged(spark, _wanted(blocks, ["a"], shared.df).join(shared.df, "a"), "blocks")
    shared.drop()
    # minima are written before they are joined: then the rows that they join can be split where a key is hot
    place = F.min(F.struct("key", "t", "s")).alias("p")
    earliest = Staged(spark, blocks.df.groupBy("a", "b").agg(place), "earliest")
    known = blocks.df.join(earliest.df, ["a", "b"])
    hit, asked = F.struct("s", "e", "p"), F.struct("s", "e")
    needed = known.groupBy("key", "t").agg(
        F.collect_set(F.when(F.col("key") > F.col("p.key"), hit)).alias("whole"),
        F.collect_set(F.when((F.col("key") == F.col("p.key")) & F.col("differ"), asked)).alias("asked"),
    )
    needed = Staged(spark, needed.where("size(whole) > 0 or size(asked) > 0"), "needed")
    blocks.drop()
    earliest.drop()
    rows = _wanted(docs.select(key.alias("key"), F.xxhash64("text").alias("t"), "text"), ["key", "t"], needed.df)
    texts = Staged(spark, rows.join(needed.df, ["key", "t"]).dropDuplicates(["key", "t"]), "texts")
    needed.drop()
    windows = _windows(texts.df)
    index = windows.groupBy("w1", "w2").agg(place, F.max("key").alias("last")).where("p.key < last").drop("last")
    index = Staged(spark, index, "index")
    found = windows.join(index.df, ["w1", "w2"]).where("key > p.key").groupBy("key", "t").agg(F.collect_list(F.struct("s", "p")).alias("single"))
    cut = stage(spark, _removed(texts.df.join(found, ["key", "t"], "left")), "removed").withColumnsRenamed({"key": "first", "t": "first_t"})
    texts.drop()
    index.drop()
    out = parsed.select("doc_id", "key", "n_words", "digest", "t").join(firsts, "digest", "left").join(cut, ["first", "first_t"], "left")
    copy = F.coalesce((F.col("n_words") >= WINDOW) & (F.col("key") > F.col("first")), F.lit(False))
    zero = F.lit(0).cast("int")
    whole = F.array(F.struct(zero.alias("start"), F.col("n_words").cast("int").alias("length"), F.col("first").alias("ref_id"), F.col("first_t").alias("ref_hash"), zero.alias("ref_start")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(copy, F.array(F.concat(F.lit("0:"), F.col("n_words").cast("string")))).otherwise(F.coalesce("spans", F.array().cast("array<string>"))).alias("spans"),
        F.when(copy, whole).otherwise(F.coalesce("factors", F.array().cast(FACTORS))).alias("factors"),
    )
