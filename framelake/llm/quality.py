"""Quality rules by weak supervision.

Each rule votes keep (+1), drop (-1) or abstains (0); most rules see one kind of defect and abstain otherwise.
Expectation-maximisation over the counts of vote patterns (at most 3 ** len(RULES), whatever the corpus size) estimates
how each rule votes on good and on bad documents, and the share of good ones; the posterior probability of "good"
replaces a conjunction of all rules.

Edge cases: a null or empty text has no words, all counts are 0 and base_failed is true. Repeated rows and
null ids are scored row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import WORD_SPACE, slices, stage

SYMBOLS = b"#*$%&|<>"
SYMBOL = re.compile(rb"[#*$%&|<>]")
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", votes string"


@dataclass(frozen=True)
class TextStats:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    n_lines: int = 0
    n_upper: int = 0
    n_exclaim: int = 0
    n_closed_lines: int = 0
    n_marks: int = 0
    n_marked_words: int = 0


def text_stats(text: str | None) -> TextStats:
    """Counts over one whole text; linear in its length."""
    if not text:
        return TextStats()
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return TextStats(n_symbols=len(data) - len(data.translate(None, SYMBOLS)))
    spaces = len(data) - len(data.translate(None, WORD_SPACE))
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(windows) > 1:
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered_to = 0
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeat += at + 3 - max(at, covered_to)
                    covered_to = at + 3
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(WORD_SPACE)]
    return TextStats(
        n_words=len(words),
        word_chars=len(text) - spaces,
        n_symbols=symbols,
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeat,
        n_lines=len(lines),
        n_upper=sum(1 for w in words if len(w) > 1 and w.isupper()),
        n_exclaim=data.count(b"!"),
        n_closed_lines=sum(1 for line in lines if line.rstrip(WORD_SPACE)[-1:] in b".!?:;\"')"),
        n_marks=len(data) - len(data.translate(None, MARKS)),
        n_marked_words=sum(1 for w in words if SYMBOL.search(w)) if symbols else 0,
    )


def _drop(value: float, least: float) -> int:
    return -1 if value >= least else 0


#: Name, vote, and the accuracy that estimation starts from: rules that see a defect are precise, general ones weak.
RULES = [
    ("length", lambda s: 1 if s.n_words >= 80 else -1 if s.n_words < 30 else 0, 0.65),
    ("word_length", lambda s: 1 if 3 * s.n_words <= s.word_chars <= 10 * s.n_words else -1 if s.word_chars > 16 * s.n_words or s.word_chars < 2 * s.n_words else 0, 0.65),
    ("closed_lines", lambda s: 1 if 2 * s.n_closed_lines >= s.n_lines else -1 if 10 * s.n_closed_lines < s.n_lines else 0, 0.65),
    ("symbols", lambda s: _drop(s.n_symbols, 0.1 * s.n_words + 0.5), 0.9),
    ("marked_words", lambda s: _drop(s.n_marked_words, 0.08 * s.n_words + 0.5), 0.9),
    ("marks", lambda s: _drop(s.n_marks, 0.1 * s.word_chars + 0.5), 0.9),
    ("shouting", lambda s: _drop(s.n_upper, 0.4 * s.n_words + 0.5), 0.9),
    ("exclaiming", lambda s: _drop(s.n_exclaim, 0.3 * s.n_words + 0.5), 0.9),
    ("repeated_lines", lambda s: _drop(s.n_dup_lines, 0.3 * s.n_lines + 0.5), 0.8),
    ("repeated_words", lambda s: _drop(s.n_repeat_words, 0.4 * s.n_words + 0.5), 0.9),
]
#: Documents that every class and vote has beforehand.
SMOOTHING = 0.5


def pattern_of(stats: TextStats) -> str:
    return "".join("-0+"[rule(stats) + 1] for _, rule, _ in RULES)


def stats_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), *((s, pa.int64()) for s in STATS), ("votes", pa.string())])
        for batch in batches:
            for part in slices(batch):
                found = [text_stats(t) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), *(pa.array([getattr(f, s) for f in found], pa.int64()) for s in STATS), pa.array([pattern_of(f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def fit(patterns: dict[str, int], start: list[float] | None = None, rounds: int = 200) -> dict[str, float]:
    """Posterior probability of "good" for each vote pattern (one character a rule: -, 0 or +).

    The first posteriors weigh each vote by the accuracy in ``start``, which also settles which class is "good". From then
    on the share of good documents and how often each rule votes +, - or not at all on good and on bad documents are
    estimated with the posteriors in turn.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    begin = np.array([r[2] for r in RULES] if start is None else start)
    weight = np.array([patterns[n] for n in names], float)
    votes = np.array([["-0+".index(c) - 1 for c in n] for n in names])
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = 1 / (1 + np.exp(-(np.log(4.0) + votes @ np.log(begin / (1 - begin)))))
    for _ in range(rounds):
        score = []
        for p in (1 - good, good):
            mass = weight * p
            rates = (mass[:, None, None] * one_hot).sum(axis=0) + SMOOTHING
            rates /= rates.sum(axis=1, keepdims=True)
            score.append(np.log((mass.sum() + SMOOTHING) / (weight.sum() + 2 * SMOOTHING)) + (one_hot * np.log(rates)).sum(axis=(1, 2)))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(names, good.tolist()))


def judge(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, quality (posterior), votes; one row per input row."""
    stats = stage(spark, stats_of(docs), "quality")
    patterns = {r[0]: r[1] for r in stats.groupBy("votes").count().collect()}  # at most 3 ** len(RULES)
    posterior = spark.createDataFrame(sorted(fit(patterns).items()), "votes string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.join(F.broadcast(posterior), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
        .select("doc_id", *STATS, "base_failed", "kept", "quality", "votes")
    )
