"""Toxicity by nearest labelled examples under exact TF-IDF cosine over all terms.

Terms are the lower-cased words of a text and their first PREFIX letters. At most PER_LABEL examples of each label
(outside fold 0, in hash order of their ids, one for each distinct text) are learnt from. Every term of every example is
indexed. A term weighs (1 + ln of its count) times its inverse document frequency times 1 + boost * phi², where phi² (0 to 1)
tells how far its presence depends on the label among the examples; with a boost of 0 that is plain TF-IDF. Texts are
vectors of length 1 over all their terms, those that no example has included. The examples form a block-max
inverted index that is broadcast; every document of the corpus is a query for its K nearest. Their votes, weighted by
squared cosine, give a raw score, which a logistic curve calibrates. The nearest examples are the evidence.

The boost, K and the weight of doubt are chosen, and the curve is fitted, on votes that each learning fold gets from the others:
weights and neighbours come from those other folds. Rows of fold 0 decide nothing.

Edge cases: null and empty texts, and texts that share no term with any example, get the calibrated score of a
vote without evidence; ties go to the example that was indexed first (by label, then id); an empty table gives
an empty result; without both labels to learn from every score is the share of the label seen, 0 if none; of several
texts with one id, that of the smallest hash is learnt from; an id with both labels counts as toxic.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.blockmax import BlockMaxIndex
from framelake.llm.common import held_out, slices, tokens

PER_LABEL = 1500
PREFIX = 5
BLOCK = 100
#: What is chosen among: weight of a term's dependence on the label, number of neighbours, weight of a vote against.
BOOSTS = (0.0, 100.0, 1000.0)
NEIGHBOURS = (15, 51)
DOUBTS = (0.01, 0.1)
#: An example: label, id, term counts.
Example = tuple[int, int, Counter]


def term_counts(text: str | None) -> Counter:
    """Words and word beginnings (marked by a trailing *) of the whole text."""
    words = Counter(tokens(text)) if text else Counter()
    out = Counter(words)
    for word, n in words.items():
        if len(word) > PREFIX:
            out[word[:PREFIX] + b"*"] += n
    return out


@dataclass
class Model:
    vocabulary: dict[bytes, int]  # all terms of the examples
    strength: np.ndarray  # of a term, by number; the last one is that of all other terms
    index: BlockMaxIndex | None
    ids: np.ndarray
    labels: np.ndarray
    k: int = NEIGHBOURS[0]
    doubt: float = DOUBTS[0]
    slope: float = 4.0
    offset: float = 0.0
    default: float = 0.0
    boost: float = 0.0

    def query(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text's vector, whose length over all terms is 1."""
        at = np.fromiter((self.vocabulary.get(t, -1) for t in counts), np.int64, len(counts))
        w = damped(np.fromiter(counts.values(), float, len(counts))) * self.strength[at]
        length = np.sqrt(w @ w) or 1.0
        return at[at >= 0], w[at >= 0] / length

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic among the neighbours, weighted by squared cosine; less where all neighbours are far."""
        weight = cosine**2
        return float((weight * self.labels[near]).sum() / (weight.sum() + self.doubt))

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        if self.index is None:
            return self.default, [], []
        near, cosine = self.index.top(*self.query(term_counts(text)), self.k)
        return self.calibrated(self.vote(near, cosine)), self.ids[near[:3]].tolist(), cosine[:3].tolist()


def damped(n: np.ndarray) -> np.ndarray:
    """How often a term occurs in a text, as a weight."""
    return 1 + np.log(n)


@dataclass
class Postings:
    """Terms of the examples by number: (entry, term, damped count) in the order of the entries."""

    vocabulary: dict[bytes, int]
    entry: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, examples: list[Example]) -> Postings:
        vocabulary = {t: i for i, t in enumerate(sorted({t for e in examples for t in e[2]}))}
        n = [len(e[2]) for e in examples]
        term = np.fromiter((vocabulary[t] for e in examples for t in e[2]), np.int64, sum(n))
        tf = damped(np.fromiter((c for e in examples for c in e[2].values()), float, sum(n)))
        return cls(vocabulary, np.repeat(np.arange(len(examples)), n), term, tf, np.array([e[0] for e in examples], float))

    def strengths(self, learnt: np.ndarray, boosts: tuple[float, ...]) -> list[np.ndarray]:
        """By boost, the strengths of all terms (one more at the end: of a term not known) as the examples marked in ``learnt`` have them."""
        n, n_toxic, size = int(learnt.sum()), self.labels[learnt].sum(), len(self.vocabulary) + 1
        rows = learnt[self.entry]
        df = np.bincount(self.term[rows], minlength=size)
        toxic = np.bincount(self.term[rows], self.labels[self.entry[rows]], minlength=size)
        # chi-square with continuity correction, as a share of its largest value
        off = np.maximum(0.0, np.abs(toxic * (n - n_toxic) - (df - toxic) * n_toxic) - n / 2)
        phi = off**2 / np.maximum(1, df * (n - df) * n_toxic * (n - n_toxic))
        return [np.log((1 + n) / (1 + df)) * (1 + b * phi) for b in boosts]

    def vectors(self, strength: np.ndarray) -> np.ndarray:
        """The weights of all postings, each entry's vector of length 1."""
        w = self.tf * strength[self.term]
        length = np.sqrt(np.bincount(self.entry, w * w, minlength=len(self.labels)))
        return w / np.where(length > 0, length, 1.0)[self.entry]

    def index(self, vectors: np.ndarray, learnt: np.ndarray) -> BlockMaxIndex:
        """Of the examples marked in ``learnt``, numbered anew in their order; texts of one label and like length share a block."""
        number = np.cumsum(learnt) - 1
        by_length = np.lexsort((np.bincount(self.entry, minlength=len(learnt))[learnt], self.labels[learnt]))
        rows = learnt[self.entry] & (vectors > 0)
        return BlockMaxIndex(number[self.entry[rows]], self.term[rows], vectors[rows], int(learnt.sum()), len(self.vocabulary), BLOCK, by_length)


def votes_across(postings: Postings, fold: np.ndarray, boosts: tuple[float, ...], neighbours: tuple[int, ...], doubts: tuple[float, ...]) -> dict[tuple, np.ndarray]:
    """By setting, the vote that each example gets from the examples of the other folds."""
    labels, votes = postings.labels, {(b, k, d): np.zeros(len(fold)) for b in boosts for k in neighbours for d in doubts}
    ends = np.searchsorted(postings.entry, np.arange(len(fold) + 1))
    for f in np.unique(fold):
        others = fold != f
        if len(set(labels[others].tolist())) < 2:
            continue  # nothing to learn from: votes without evidence
        for boost, strength in zip(boosts, postings.strengths(others, boosts)):
            vectors = postings.vectors(strength)
            model = Model({}, strength, postings.index(vectors, others), np.zeros(0), labels[others])
            for i in np.flatnonzero(fold == f):
                own = slice(ends[i], ends[i + 1])
                near, cosine = model.index.top(postings.term[own], vectors[own], max(neighbours))
                for k in neighbours:
                    for model.doubt in doubts:
                        votes[boost, k, model.doubt][i] = model.vote(near[:k], cosine[:k])
    return votes


def fit(examples: list[Example], share: float | None = None, folds: list[int] | None = None, boosts: tuple[float, ...] = BOOSTS, neighbours: tuple[int, ...] = NEIGHBOURS, doubts: tuple[float, ...] = DOUBTS) -> Model:
    """share: of toxic among all that is labelled (None: as in the examples); folds: those of the ids by default.

    With each setting every example gets the vote of the folds that it isn't in. The setting whose calibrated votes have
    the least log-loss is taken, with its curve, and all examples are indexed.
    """
    order = sorted(range(len(examples)), key=lambda i: (examples[i][0], examples[i][1]))
    fold = np.array([zlib.crc32(str(examples[i][1]).encode()) % 5 if folds is None else folds[i] for i in order])
    examples = [examples[i] for i in order]
    labels = np.array([e[0] for e in examples], float)
    if len(set(labels.tolist())) < 2:
        return Model({}, np.zeros(1), None, np.zeros(0, np.int64), labels, default=float(labels.mean()) if len(labels) else 0.0)
    share = labels.mean() if share is None else share
    postings = Postings.of(examples)
    votes = votes_across(postings, fold, boosts, neighbours, doubts)
    curves = {s: logistic(x, labels, share) for s, x in votes.items()}
    best = min(votes, key=lambda s: (round(curves[s][2], 9), s))
    everyone = np.ones(len(examples), bool)
    strength = postings.strengths(everyone, best[:1])[0]
    index = postings.index(postings.vectors(strength), everyone)
    return Model(postings.vocabulary, strength, index, np.array([e[1] for e in examples], np.int64), labels, best[1], best[2], *curves[best][:2], boost=best[0])


def logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float, float]:
    """Slope, offset (Newton's method, lightly regularised) and mean log-loss; the classes weigh as in all that is labelled."""
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y <= 0).sum())) * len(y)
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-2 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
    return float(beta[0]), float(beta[1]), float(loss)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Reads at most ``per_label`` labelled documents of either label; each is brought back as its term counts."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = labelled.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    share = learn.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit(2**31 - 1))
    first = [learn.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_label) for label in (0, 1)]
    ids = first[0].unionByName(first[1])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                counts = [term_counts(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), part.column("h"), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                    names=["doc_id", "toxic", "h", "terms", "n"],
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    one = text.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.h", "t.text")
    rows = one.mapInArrow(run, "doc_id long, toxic int, h long, terms array<binary>, n array<int>").toArrow()
    examples, seen = [], set()
    for r in sorted((r for b in rows.to_batches() for s in slices(b) for r in s.to_pylist()), key=lambda r: (-r["toxic"], r["doc_id"])):
        if r["h"] not in seen:  # copies are one example, toxic if one of them is
            seen.add(r["h"])
            examples.append((r["toxic"], r["doc_id"], Counter(dict(zip(r["terms"], r["n"])))))
    return fit(examples, share)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples), evidence_cosine; a row per row."""
    shared = spark.sparkContext.broadcast(model)  # 2 * PER_LABEL examples

    def run(batches):
        import pyarrow as pa

        m = shared.value
        kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        for batch in batches:
            for part in slices(batch):
                seen: dict[int, tuple] = {}
                found = []
                for t in part.column("text").to_pylist():
                    key = zlib.crc32(t.encode("utf-8", "replace")) if t else -1
                    if key not in seen or seen[key][0] != t:
                        seen[key] = (t, m.score(t))
                    found.append(seen[key][1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["doc_id", "score", "evidence", "evidence_cosine"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<bigint>, evidence_cosine array<double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_cosine")
