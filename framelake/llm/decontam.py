"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage of the corpus.

Test items are indexed (block-max, about SHARD items an index; document frequencies and mean length are those of all
items). ROUND indexes are broadcast and queried in one pass over the documents; more items take further passes, and a
pass's indexes are given up before the next, so what a worker holds doesn't grow with the items. Passages overlap, so that a run of words as long as the longest item lies in one passage whole. A passage
retrieves every item whose BM25 score reaches the item's floor: the least score that a passage holding the
share CONTAINED of the item's shingles can have, so retrieval loses no verified match. A group of passages is
queried first as a whole; as scores only grow with more words, groups without a hit need no finer queries.
Retrieved pairs are verified exactly: the passage holds the share CONTAINED of the item's word shingles. The shares
of the words of its question (all but its last sentence) and of its answer (its last sentence) are reported; they
decide nothing, as a copy may lack the last sentence, which is often a fragment.

Edge cases: null and empty texts match nothing, nor do items without words; an item of fewer than SHINGLE words
is one shingle; repeated rows each give their matches; items that share a text but not an id are separate items with
equal results, rows that share both are one; a null item_id stays null; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.blockmax import BlockMaxIndex
from framelake.llm.common import slices, stage, tokens

SHINGLE = 5
CONTAINED = 0.8
SHARD = 2048
ROUND = 16
BLOCK = 16
K1, B = 1.2, 0.75
#: Passages in a group that is queried as a whole first.
GROUP = 8
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SCHEMA = "doc_id long, item_id long, passage_start long, score double, containment double, question_overlap double, answer_overlap double"


@dataclass
class Item:
    item_id: int | None
    shingles: frozenset
    question: frozenset
    answer: frozenset


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    items: list[Item]
    postings: BlockMaxIndex
    floors: np.ndarray
    block_floors: np.ndarray
    stride: int


def shingles(ids: list[int]) -> set[tuple]:
    if not ids:
        return set()
    if len(ids) < SHINGLE:
        return {tuple(ids)}
    return set(zip(*(ids[i:] for i in range(SHINGLE))))


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; one sentence is both."""
    parts = [p for p in SENTENCE.split(text.strip()) if tokens(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def build(rows: list[tuple[int | None, str]], everything: tuple[int, float, int, dict[bytes, int]] | None = None) -> Index | None:
    """The index of one shard of items; everything: number, mean and largest length, document frequencies of all items."""
    rows = sorted({(i, t) for i, t in rows if t and tokens(t)}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return None
    texts = [tokens(t) for _, t in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    coded = [[vocabulary[w] for w in t] for t in texts]
    if everything:
        n, mean, longest, df = *everything[:3], np.array([everything[3][w] for w in vocabulary], float)
    else:
        n, mean, longest, df = len(coded), sum(map(len, coded)) / len(coded), max(map(len, coded)), np.zeros(len(vocabulary))
        for c in coded:
            df[list(set(c))] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    entry, term, weight, floors, items = [], [], [], [], []
    for i, c in enumerate(coded):
        terms, tf = np.unique(c, return_counts=True)
        w = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
        entry.append(np.full(len(terms), i))
        term.append(terms)
        weight.append(w)
        own = shingles(c)
        # a word is missing only if all shingles that cover it are, so at most this many words can be
        missing = int((1 - CONTAINED) * len(own) + 1e-9)
        floors.append((w.sum() - np.sort(w)[::-1][:missing].sum()) * (1 - 1e-9))
        q, a = question_and_answer(rows[i][1])
        items.append(Item(rows[i][0], frozenset(own), frozenset(vocabulary[x] for x in tokens(q)), frozenset(vocabulary[x] for x in tokens(a))))
    postings = BlockMaxIndex(np.concatenate(entry), np.concatenate(term).astype(np.int64), np.concatenate(weight), len(items), len(vocabulary), BLOCK)
    floors = np.array(floors)
    return Index(vocabulary, items, postings, floors, postings.least_by_block(floors) if len(floors) else floors, max(64, -(-5 * longest // 4)))


def matches(index: Index, words: list[bytes]) -> list[tuple]:
    """(item_id, passage_start, score, containment, question_overlap, answer_overlap): the best passage of each item."""
    ids = np.array([index.vocabulary.get(w, -1) for w in words], np.int64)
    best: dict[int, tuple] = {}

    def found(at: int, n: int) -> np.ndarray:
        part = ids[at : at + n]
        terms = np.unique(part[part >= 0])
        return index.postings.above(terms, np.ones(len(terms)), index.floors, index.block_floors)

    s = index.stride
    for at in range(0, max(1, len(ids) - s), GROUP * s):
        if not len(found(at, (GROUP + 1) * s)[0]):
            continue
        for start in range(at, min(at + GROUP * s, max(at + 1, len(ids) - s)), s):
            hit, scores = found(start, 2 * s)
            if not len(hit):
                continue
            passage = ids[start : start + 2 * s].tolist()
            have, here = shingles(passage), set(passage)
            for i, score in zip(hit.tolist(), scores.tolist()):
                item = index.items[i]
                if len(next(iter(item.shingles))) < SHINGLE:
                    n = len(next(iter(item.shingles)))
                    part = len(item.shingles & set(zip(*(passage[k:] for k in range(n)))))
                else:
                    part = len(item.shingles & have)
                row = (part / len(item.shingles), len(item.question & here) / len(item.question), len(item.answer & here) / len(item.answer))
                if row[0] >= CONTAINED and (i not in best or (row[0], score) > (best[i][2], best[i][1])):
                    best[i] = (start, score, *row)
    return [(index.items[i].item_id, start, score, c, q, a) for i, (start, score, c, q, a) in sorted(best.items())]


def counted(items: DataFrame) -> DataFrame:
    """item_id, text, shard and its words: one row for each distinct item with words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = [tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["item_id", "text", "n", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, text string, n long, words array<binary>").where("n > 0")


def indexes(spark: SparkSession, items: DataFrame, shard: int = SHARD) -> Iterator[Index]:
    """The indexes, one after the other: the driver holds the items and words of one shard at a time."""
    rows = stage(spark, counted(items), "items")
    total, mean, longest = rows.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    if not total:
        return
    n = -(-total // shard)
    if n == 1:
        yield build([(r.item_id, r.text) for r in rows.select("item_id", "text").collect()])
        return
    rows = stage(spark, rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "shards")
    words = rows.select("shard", F.explode("words").alias("word"))
    df = stage(spark, words.groupBy("word").agg(F.count("*").alias("df")), "df")
    for i in range(n):
        part = rows.where(F.col("shard") == i)
        found = words.where(F.col("shard") == i).select("word").distinct().join(df, "word").collect()  # a shard's words
        built = build([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], (total, mean, longest, {bytes(r.word): r.df for r in found}))
        if built:
            yield built


def rounds(spark: SparkSession, items: DataFrame, shard: int = SHARD) -> Iterator[list]:
    """Broadcast lists of at most ROUND indexes."""
    held: list[Index] = []
    for index in indexes(spark, items, shard):
        held.append(index)
        if len(held) == ROUND:
            yield spark.sparkContext.broadcast(held)
            held = []
    if held:
        yield spark.sparkContext.broadcast(held)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each row of ``docs`` and item that it holds. No shuffle: documents meet the indexes in place."""
    texts, out, before = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None, None

    def matching(shared):
        def run(batches):
            import pyarrow as pa

            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_start", pa.int64()), *((c, pa.float64()) for c in ("score", "containment", "question_overlap", "answer_overlap"))])
            for batch in batches:
                for part in slices(batch):
                    rows = []
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        if text:
                            words = tokens(text)
                            for index in shared.value:
                                rows += [(doc_id, *m) for m in matches(index, words)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return texts.mapInArrow(run, SCHEMA)

    for shared in rounds(spark, items, shard):
        if before is not None:  # one pass is done before the next one's indexes are sent
            done = stage(spark, matching(before), "matches")
            before.destroy()
            out = done if out is None else out.unionByName(done)
        before = shared
    if before is None:
        return spark.createDataFrame([], SCHEMA)
    return matching(before) if out is None else out.unionByName(matching(before))


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows, unchanged and with all their columns, whose text holds no test item."""

    def clean(rows, shared):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in slices(batch):
                    keep = []
                    for text in part.column("text").to_pylist():
                        words = tokens(text) if text else []
                        keep.append(not any(matches(index, words) for index in shared.value))
                    yield part.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    out, before = docs, None
    for shared in rounds(spark, items, shard):
        if before is not None:
            out = stage(spark, clean(out, before), "clean")
            before.destroy()
        before = shared
    return out if before is None else clean(out, before)
