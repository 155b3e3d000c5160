"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of letter 2- and 3-grams (hashed to DIM buckets). Each language has
several spherical k-means centroids; a text gets the language of the centroid with the largest cosine, and is
rejected when that cosine is below a share of what the language's own training texts reach. Short texts reach less, so
training texts are also cut to lengths, and a text of fewer than SHORT n-grams is held against cuts of about its length.

Training reads at most PER_LANGUAGE documents of each language, in hash order of their ids (of several texts with one id,
that of the smallest hash); each language's centroids are one task. A language's centroids take CENTROIDS * DIM * 4
bytes (128 KB), so MOST_LANGUAGES bound what is broadcast; more values of ``lang`` are an error. The corpus is
scored whole. Edge cases: null text or a text without any letter gives ``und``, score 0 and rejected; ties go
to the first language by name; with nothing to learn from every row is ``und``; repeated rows score alike.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import LETTERS_ONLY, held_out, sample_ids, slices, stage

DIM_BITS = 13
DIM = 1 << DIM_BITS
PER_LANGUAGE = 400
CENTROIDS = 4
MOST_LANGUAGES = 1500
#: Texts of fewer n-grams than this are held against cuts whose n-gram count has as many binary digits, others against
#: whole texts.
SHORT = 400
BINS = SHORT.bit_length()
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 2- and 3-grams over the UTF-8 bytes of the lower-cased letters of the whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()) + b" "
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(data), 1 << 20):  # long texts in pieces that overlap by two bytes
        a = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        if len(a) < 3:
            continue
        two = (a[:-2] << np.uint32(8)) | a[1:-1]
        three = (two << np.uint32(8)) | a[2:]
        for grams in (two, three):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return out


def cuts(text: str) -> list[bytes]:
    """A run of words for each number of binary digits up to BINS that the text's n-gram count exceeds: sparse counts.

    Places and lengths depend on the text alone.
    """
    words = text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()
    ends = np.cumsum([0] + [len(w) + 1 for w in words])
    rng, out = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), []
    for digits in range(1, BINS + 1):
        want = 2 ** (digits - 1 + rng.random()) / 2  # a byte more makes a 2-gram and a 3-gram more
        last = int(np.searchsorted(ends, ends[-1] - want, side="right")) - 1
        if last < 0:
            break
        first = rng.randint(0, last)
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + want, side="right")) - 1)
        counts = gram_counts(b" ".join(words[first:end]).decode("utf-8", "replace"))
        out.append(packed(counts))
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows are unit vectors
    owner: np.ndarray  # index of the language of each centroid
    least: np.ndarray  # least accepted cosine by language and binary digits of the n-gram count, BINS + 1 for whole texts

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        n = np.sqrt(v @ v)
        return (v / n if n else v).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        counts = gram_counts(text)
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        n = int(counts.sum())
        far = score < self.least[self.owner[best], n.bit_length() if n < SHORT else BINS + 1]
        return self.languages[self.owner[best]], score, bool(far)


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds: no random choice."""
    mean = vectors.sum(axis=0)
    seeds = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        seeds.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    centres = vectors[seeds]
    for _ in range(rounds):
        member = np.argmax(vectors @ centres.T, axis=1)
        fresh = [vectors[member == j].sum(axis=0) for j in range(len(centres)) if (member == j).any()]
        centres = np.stack([c / (np.linalg.norm(c) or 1.0) for c in fresh]).astype(np.float32)
    return centres


def train(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, share: float = 0.5) -> Model:
    """Learns from rows with a language outside fold 0 only: at most ``per_language`` of each language.

    The driver gets how many of the sample have each n-gram, and each language's centroids and bounds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    ids = sample_ids(docs, "lang", per_language, ~held_out(F.col("doc_id")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows = []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if text and LETTER.search(text):
                        rows.append((lang, packed(gram_counts(text)), cuts(text)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["lang", "grams", "cuts"])

    sampled = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    one = sampled.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("lang", "t.text")
    rows = stage(spark, one.mapInArrow(run, "lang string, grams binary, cuts array<binary>"), "languages")
    n_rows, n_languages = rows.agg(F.count("*"), F.count_distinct("lang")).first()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"{n_languages} languages to learn; MOST_LANGUAGES is {MOST_LANGUAGES}")

    def present(batches):
        import pyarrow as pa

        df = np.zeros(DIM, np.int64)
        for batch in batches:
            for grams in batch.column("grams").to_pylist():
                df[unpacked(grams)[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM), pa.int64()), pa.array(df, pa.int64())], names=["gram", "n"])

    df = np.zeros(DIM, np.int64)
    for r in rows.select("grams").mapInArrow(present, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIM rows
        df[r.gram] = r.n
    idf = weights_of(n_rows, df)

    def learn(key, table):
        import pyarrow as pa

        found = sorted(zip(table.column("grams").to_pylist(), table.column("cuts").to_pylist()))
        centres, least = language(idf, [unpacked(g) for g, _ in found], [unpacked(c) for _, cs in found for c in cs], k, share)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "centres": pa.array([centres.tobytes()], pa.binary()), "least": pa.array([least.tolist()], pa.list_(pa.float64()))})

    learnt = rows.groupBy("lang").applyInArrow(learn, "lang string, centres binary, least array<double>").collect()  # at most MOST_LANGUAGES rows
    return assembled(idf, [(r.lang, np.frombuffer(r.centres, np.float32).reshape(-1, DIM), np.array(r.least)) for r in learnt])


def packed(counts: np.ndarray) -> bytes:
    """Sparse counts: buckets, then their counts."""
    at = np.flatnonzero(counts)
    return np.concatenate([at, counts[at]]).astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).reshape(2, -1).astype(np.int64)


def weights_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 0.1


def language(idf: np.ndarray, texts: list[np.ndarray], short: list[np.ndarray], k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language, and the least accepted cosine by length, from sparse counts of texts and of cuts."""
    vectors = np.zeros((len(texts), DIM), np.float32)
    for row, (at, n) in zip(vectors, texts):
        row[at] = np.log1p(n) * idf[at]
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    centres = clusters(vectors, k)
    least = np.full(BINS + 2, share * np.quantile((vectors @ centres.T).max(axis=1), 0.01))
    reached: dict[int, list[float]] = {}
    for at, n in short:
        if n.sum() < SHORT:
            v = np.log1p(n) * idf[at]
            reached.setdefault(int(n.sum()).bit_length(), []).append(float((centres[:, at] @ v).max() / (np.sqrt(v @ v) or 1.0)))
    for digits, c in reached.items():
        least[digits] = share * np.quantile(c, 0.01)
    return centres, np.minimum.accumulate(least[::-1])[::-1]  # a shorter text needs no more than a longer one


def assembled(idf: np.ndarray, learnt: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    learnt = sorted(learnt, key=lambda x: x[0])
    if not learnt:
        return Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros((0, BINS + 2)))
    owner = np.concatenate([np.full(len(c), i) for i, (_, c, _) in enumerate(learnt)])
    return Model([lang for lang, _, _ in learnt], idf, np.concatenate([c for _, c, _ in learnt]), owner, np.stack([x for _, _, x in learnt]))


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; one row per input row."""
    shared = spark.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * CENTROIDS * DIM floats

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [m.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_accepted(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows, unchanged and with all their columns, whose text is not rejected. No shuffle."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for part in slices(batch):
                keep = [not m.predict(t)[2] for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
