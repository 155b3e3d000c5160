"""Mixing sources to target weights by the cube method.

A document of a source with target/size ratio r is taken floor(r) times, and once more with probability
r - floor(r). Which documents get the extra turn is a balanced sample: the flight phase of the cube method
moves the inclusion probabilities of few documents at a time through the null space of the constraints (token
total and document total of the source), so both totals stay exact until only a landing problem remains.

The flight runs in chunks of about CHUNK documents of one source, dealt by a hash of the id, so a hot source is
many tasks. Each chunk leaves at most LEFT fractional documents; these meet in further flights, CHUNK times
fewer at each level, until a source's rest is one landing problem. Documents are visited from large to small
and a reserve of each source stays out of the flights, so that the landing can make up for what rounding misses.
Documents that are a large part of their source are decided before, in a flight and landing of their own; what that
misses is added to the ratio of the source's other documents.

Edge cases: null texts and texts without words have size 0, belong to no constraint and are taken floor(r) times;
a null source is a source of its own, last in order; a source without words has target 0. Rows are told apart by
source, id and a hash of all their columns, so texts that share an id, or have none, are decided one by one. n rows
that agree in all of this are one unit: the whole part of n * p of them is taken, and one more with the rest of it.
Which of equal rows have the extra turns is all that the layout of the table can change. Reruns agree: chunks and
random numbers come from ids and hashes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD_PATTERN, stage

WEIGHTS = (1, 2, 3)
MOST = 3
CHUNK = 4096
LEFT = 2
#: Sources whose names and numbers take up to so many bytes are joined by broadcast; beyond, by a shuffle.
BROADCAST_BYTES = 16 << 20
UNIT = "u string, size long, p double, reserve boolean"
#: Units of a source, of those no larger than its mean, that only the landing decides (all of a small source's).
RESERVE = 512
#: A document of more than this part of its source is decided first (so a source has fewer than GIANT of them).
GIANT = 50


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target from (source, source_size, n_docs).

    Targets are min(MOST * size, level * weight): capped sources' excess is reshared by weight until none is above its
    cap. The level follows from the sources in order of cap / weight. One row a source goes through the windows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.lit(float(MOST)) * F.col("source_size")
    out = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", cap)
    everything = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = (
        out.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_after", F.sum("weight").over(after))
        .withColumn("level_here", (F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_after"))
    )
    # the first source, in this order, that its level doesn't fill sets the level of it and all after it
    open_ = F.col("level_here") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level_here").alias("level")))).over(everything)["level"]
    return out.withColumn("level", level).select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(seed: str) -> float:
    return int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=7).digest(), "big") / 2.0**56


def flight(sizes: list[int], p: list[float], seed: str) -> list[float]:
    """Flight phase: at most LEFT probabilities stay strictly between 0 and 1; Σp and Σsize*p are kept.

    Three undecided units span a one-dimensional null space of the two constraints; a step along it, to one side
    or the other with the probabilities that keep every expectation, decides at least one of them.
    """
    rng = np.random.default_rng(int(_uniform(seed) * 2**53))
    draws = rng.random(len(p) + 3).tolist()
    p = list(p)
    eps = 1e-9
    hand: list[int] = []
    order = sorted(range(len(p)), key=lambda i: (-sizes[i], i))
    at, step = 0, 0
    while True:
        while len(hand) < LEFT + 1 and at < len(order):
            if eps < p[order[at]] < 1 - eps:
                hand.append(order[at])
            at += 1
        if len(hand) < LEFT + 1:
            break
        a, b, c = hand
        u = (float(sizes[b] - sizes[c]), float(sizes[c] - sizes[a]), float(sizes[a] - sizes[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(hand, u) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(hand, u) if x)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, x in zip(hand, u):
            p[i] = min(1.0, max(0.0, p[i] + move * x))
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = round(p[i])
        hand = [i for i in hand if 0.0 < p[i] < 1.0]
    return p


def landing(sizes: list[int], p: list[float], reserve: list[bool], seed: str) -> list[float]:
    """Decides a source's last units; the token total misses its target by about the smallest of them.

    The flight runs over all but the reserve; the two units that it can leave take the whole-number choice nearest in
    tokens. What that misses is spread over the undecided reserve: from large to small, each reserve unit is
    taken with its probability plus the share of the miss per token that is still to be decided.
    """
    first = [i for i, r in enumerate(reserve) if not r]
    p = [float(round(x)) if x <= 1e-9 or x >= 1 - 1e-9 else x for x in p]
    for i, x in zip(first, flight([sizes[i] for i in first], [p[i] for i in first], seed)):
        p[i] = x
    left = [i for i in first if 0.0 < p[i] < 1.0]
    miss, few = sum(sizes[i] * p[i] for i in left), sum(p[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (round(abs(sum(sizes[i] for j, i in enumerate(left) if m >> j & 1) - miss), 6), round(abs(m.bit_count() - few), 6), m))
    for j, i in enumerate(left):
        p[i] = float(best >> j & 1)
        miss -= sizes[i] * p[i]
    last = sorted((i for i, r in enumerate(reserve) if r and 0.0 < p[i] < 1.0), key=lambda i: (-sizes[i], i))
    draws = np.random.default_rng(int(_uniform(seed + "landing") * 2**53)).random(len(last))
    rest = float(sum(sizes[i] for i in last))
    for i, u in zip(last, draws.tolist()):
        due = p[i] + miss / rest
        taken = 1.0 if u < due else 0.0
        miss += sizes[i] * (p[i] - taken)
        rest -= sizes[i]
        p[i] = taken
    return p


def _level(units: DataFrame) -> DataFrame:
    """One flight for each (source, chunk) of about CHUNK units; where a source is one chunk (m = 1), it also lands."""

    def run(key, table):
        import pyarrow as pa

        s, m, chunk = (k.as_py() for k in key)
        rows = sorted(table.select(["u", "size", "p", "reserve"]).to_pylist(), key=lambda r: r["u"])
        sizes, p, seed = [r["size"] for r in rows], [r["p"] for r in rows], f"{s}:{m}:{chunk}"
        p = landing(sizes, p, [r["reserve"] for r in rows], seed) if m == 1 else flight(sizes, p, seed)
        n = len(rows)
        return pa.table({"s": pa.array([s] * n, pa.string()), "m": pa.array([m] * n, pa.int64()), "u": pa.array([r["u"] for r in rows], pa.string()), "size": pa.array([r["size"] for r in rows], pa.int64()), "p": pa.array(p, pa.float64()), "reserve": pa.array([r["reserve"] for r in rows], pa.bool_())})

    return units.select("s", "m", "chunk", "u", "size", "p", "reserve").groupBy("s", "m", "chunk").applyInArrow(run, "s string, m long, " + UNIT)


def sized(docs: DataFrame, name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def _unit(docs: DataFrame) -> Column:
    """Names a row within its source: its id and a hash of all columns that can be hashed."""
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.hex(F.xxhash64(*whole)))


def _ranked(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of units that only some of the rows of have the extra turn, with their copies.

    rows: s, u, piece and others; few: s, u, extra, base. Rows are numbered within their piece (a task's share of the
    table when it was written) and pieces by their counts, so no task holds all rows of a unit.
    """
    rows = rows.join(few, ["s", "u"])
    pieces = rows.groupBy("s", "u", "piece").agg(F.count("*").alias("n_piece"))
    before = Window.partitionBy("s", "u").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n_piece").over(before), F.lit(0))).drop("n_piece")
    number = F.row_number().over(Window.partitionBy("s", "u", "piece").orderBy("piece"))
    out = rows.withColumn("number", number).join(pieces, ["s", "u", "piece"])
    return out.withColumn("copies", (F.col("base") + (F.col("before") + F.col("number") <= F.col("extra")).cast("long")).cast("long")).drop("number", "before", "extra", "base")


def _decided(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Units (s, u, n, base, extra: how many of the n rows have a turn more), sources (source, source_size, target, s),
    and the hint that a join with the sources takes. rows: source, s, u, size.
    """
    goal = stage(spark, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))).withColumn("s", _key(F.col("source"))), "targets")
    width = 2 * F.coalesce(F.octet_length("source"), F.lit(0)) + 64  # a name stands in two columns
    n_bytes, largest = goal.agg(F.sum(width), F.max("n_docs")).first()
    hint = F.broadcast if (n_bytes or 0) <= BROADCAST_BYTES else lambda x: x
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = rows.where("size > 0").groupBy("s", "u").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    shared = shared.join(hint(goal.select("s", "n_docs", "source_size", ratio.alias("ratio"))), "s").withColumn("giant", F.col("size") * GIANT > F.col("source_size"))
    # of n equal rows, floor(n * p) have the extra turn for sure; what is left of n * p is the unit's probability
    due = lambda df: df.withColumn("base", F.floor(F.col("ratio") + 1e-12)).withColumn("due", F.col("n") * F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))
    turn = lambda df: due(df).withColumn("sure", F.floor(F.col("due") + 1e-12)).withColumn("p", F.greatest(F.col("due") - F.col("sure"), F.lit(0.0))).drop("due")
    # giants are decided first; what rounding them misses moves the ratio of the source's other documents
    shared = stage(spark, shared, "units")
    giants = turn(shared.where("giant")).select("s", "u", "size", "n", "p", F.lit(False).alias("reserve"), F.lit(1).cast("long").alias("m"), F.lit(0).cast("long").alias("chunk"))
    decided = stage(spark, _level(giants), "giants")
    owed = giants.groupBy("s").agg(F.sum(F.col("size") * F.col("p")).alias("due"), F.sum(F.col("size") * F.col("n")).alias("giant_size"))
    miss = owed.join(decided.groupBy("s").agg(F.sum(F.col("size") * F.col("p")).alias("got")), "s")
    miss = stage(spark, miss.select("s", (F.col("due") - F.col("got")).alias("miss"), "giant_size"), "miss")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), F.col("ratio") + F.coalesce(F.col("miss") / F.nullif(F.col("source_size") - F.col("giant_size"), F.lit(0)), F.lit(0.0))))
    settle = lambda df: turn(df.join(hint(miss), "s", "left").withColumn("ratio", F.when(F.col("giant"), F.col("ratio")).otherwise(moved))).drop("miss", "giant_size")
    settled = settle(shared)
    units = settled.where("not giant and p > 1e-9")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("long")
    part = F.ceil(F.col("n_docs") / RESERVE)
    units = units.withColumn("reserve", (F.pmod(F.xxhash64(F.lit(5), "u"), part) == 0) & (F.col("size") * F.col("n_docs") <= F.col("source_size"))).withColumn("m", chunks(F.col("n_docs")))
    held = units.where("reserve and m > 1").withColumn("m", F.lit(1).cast("long"))
    units = units.where("not reserve or m = 1")
    level, most = 0, largest or 0
    while True:
        flown = stage(spark, _level(units.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11 + level), "u"), F.col("m")))), f"flight{level}")
        decided = decided.unionByName(flown.where("p = 0 or p = 1"))
        if most <= CHUNK:
            break
        # sources that are one chunk now meet their reserve, which then takes part in the landing
        most = -(-most // CHUNK) * LEFT
        before = F.col("m") * LEFT
        units = flown.where("p > 0 and p < 1").withColumn("m", chunks(before)).select("s", "m", "u", "size", "p", "reserve")
        waiting = held.withColumn("was", chunks(F.col("n_docs")))
        for _ in range(level + 1):
            waiting = waiting.withColumn("past", F.col("was")).withColumn("was", chunks(F.col("was") * LEFT))
        units = units.unionByName(waiting.where("was = 1 and past > 1").select("s", "m", "u", "size", "p", "reserve"))
        level += 1
    one = decided.where("p = 1").select("s", "u", F.lit(1).alias("one"))
    out = settled.join(one, ["s", "u"], "left").select("s", "u", "n", "base", (F.col("sure") + F.coalesce(F.col("one"), F.lit(0))).alias("extra"))
    return stage(spark, out, "decided"), goal, hint


def _key(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))


#: Some of a unit's equal rows have the extra turn, others not.
SOME = "coalesce(extra > 0 and extra < n, false)"
#: Turns of a row of any other unit; rows without words are in no unit and have the whole turns of their source.
COPIES = "cast(coalesce(base + cast(extra > 0 as long), floor(case when source_size > 0 then target / source_size else 0e0 end + 1e-12)) as long)"


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per input row."""
    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", _unit(docs).alias("u"))).drop("text")
    rows = stage(spark, rows.select("*", _key(F.col("source")).alias("s"), F.spark_partition_id().alias("piece")), "sizes")
    units, goal, hint = _decided(spark, rows)
    sources = hint(goal.select("s", "source_size", "target"))
    out = rows.join(units, ["s", "u"], "left").where("not " + SOME).join(sources, "s").withColumn("copies", F.expr(COPIES)).drop("n", "base", "extra")
    out = out.unionByName(_ranked(rows, units.where(SOME).select("s", "u", "base", "extra")).join(sources, "s"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, each as often as the mix takes it.

    A further column ``copy`` (with underscores if ``docs`` has that name) counts a row's turns from 1. Rows without words
    are taken as often as their source's whole turns.
    """
    name = "copy"
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), "text", _unit(docs).alias("u"))
    rows = packed.select("row", _key(F.col("source")).alias("s"), "u")
    narrow = stage(spark, sized(packed).select("source", _key(F.col("source")).alias("s"), "u", "size"), "sizes")
    units, goal, hint = _decided(spark, narrow)
    out = rows.join(units, ["s", "u"], "left").where("not " + SOME).join(hint(goal.select("s", "source_size", "target")), "s")
    out = out.withColumn("copies", F.expr(COPIES)).where("copies > 0").select("row", "copies")
    some = units.where(SOME).select("s", "u", "base", "extra")
    if not some.isEmpty():  # repeated rows only
        repeated = stage(spark, rows.join(some.select("s", "u"), ["s", "u"], "left_semi").withColumn("piece", F.spark_partition_id()), "repeated")
        out = out.unionByName(_ranked(repeated, some).where("copies > 0").select("row", "copies"))
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))
