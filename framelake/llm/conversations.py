"""Repair of conversations by a dynamic programme over the turns that are retained.

Edits: a row is kept (K, 0), gets the role user or assistant (R, 3) or is deleted (D, 4); rows with an empty text may be
inserted anywhere (I, 3). Blank rows and repeats must go; a truncated row that stays costs 3 more. What remains must have
role initials ``(s?(ua)+)?``. Of the cheapest repairs the one whose string of edits is least in ASCII order is taken.

Retained rows are the programme's nodes: a row that stays follows the last one retained, or nothing. The rows between are
deletions, whose price is a difference of prefix sums, so each state (nothing, s, u or a retained last) needs only its
running minimum of price less the sum so far. The pair of roles determines how many rows are inserted between. Two strings
of edits over the same rows never begin with one another, as each ends with a row's own letter; hence which of two is
less is settled where their paths part, and a rank of the four states at each row replaces the strings. Per row the
programme keeps one byte a state.

Rows of a conversation are taken by turn (nulls first), ties by role, then text; null roles and texts are one space. A null
conv_id is a conversation of its own. A role's initial is its first character; rows whose initial is none of s, u and a can
only be given another role or deleted. Rows go through a task in order and are not held, so a conversation that has a
third of all rows takes time (its digest is one SHA-256, which is sequential), not memory, beyond four bytes a row for the
programme. Extra columns are ignored. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import CRC_TABLE, Staged, crc_sql

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States by what was retained last. For each pair, the rows inserted between; None: not allowed.
NOTHING, S, U, A = range(4)
BETWEEN = {(NOTHING, S): "", (NOTHING, U): "", (NOTHING, A): "u", (S, U): "", (S, A): "u", (U, A): "", (U, U): "a", (A, U): "", (A, A): "u"}
#: What must be inserted at the end.
AT_END = {NOTHING: "", S: "ua", U: "a", A: ""}
ROLES = {"u": "user", "a": "assistant"}
GIVEN = {U: "user", A: "assistant"}
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, told by the checksum of conv_id:turn; dropped rows stay as marks (``dropped``)."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), (F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"), F.explode(times).alias("_t")).drop("_t")


def judged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with their place in the conversation and their first fault.

    One shuffle, by conversation; both windows stream over sorted rows. ``pos`` counts from 1; dropped rows have 0.
    """
    order = ["dropped", F.asc_nulls_first("turn"), "role", "text", "seen"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn")))
    # one code point that is no space, and the last of them
    blank, last = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    out = rows.withColumn("seen", seen).withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    out = out.withColumn("blank", blank).withColumn("duplicate", ~F.col("blank") & (F.col("seen") > 1))
    out = out.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~last.isin(".", "!", "?"))
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "dropped", "turn", "role", "text", "blank", "duplicate", "truncated")


class Programme:
    """The rows of one conversation, one after the other; at the end, the edits of the cheapest repair."""

    def __init__(self):
        self.cost = [0, None, None, None]  # by state; None: can't be reached
        self.rank = [0, 0, 0, 0]
        self.back = bytearray()  # by row and state: 16 * (0 deleted, 1 kept, 2 given a role) + the state before

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        # candidates by state: (cost, rank of the state before, letters, code)
        to = [[(c + DELETE, self.rank[s], "D", s)] if (c := self.cost[s]) is not None else [] for s in range(4)]
        if not must_go:
            for (a, b), between in BETWEEN.items():
                if (c := self.cost[a]) is None:
                    continue
                price = c + INSERT * len(between) + CUT_OFF * truncated
                letters = "I" * len(between)
                if initial == "-sua"[b]:
                    to[b].append((price, self.rank[a], letters + "K", 16 + a))
                elif b != S:
                    to[b].append((price + REROLE, self.rank[a], letters + "R", 32 + a))
        best = [min(x) if x else None for x in to]
        self.cost = [x[0] if x else None for x in best]
        order = sorted((x[1:3], s) for s, x in enumerate(best) if x)
        for place, (_, s) in enumerate(order):
            self.rank[s] = place
        self.back += bytes(x[3] if x else 255 for x in best)

    def end(self) -> tuple[int, int, bytearray, bytearray]:
        """Cost, the last state, and for each row its code and the state after it."""
        last = [(c + INSERT * len(AT_END[s]), self.rank[s], s) for s, c in enumerate(self.cost) if c is not None]
        cost, _, state = min(last)
        n, s = len(self.back) // 4, state
        codes, after = bytearray(n), bytearray(n)
        for i in range(n - 1, -1, -1):
            codes[i], after[i] = self.back[4 * i + s], s
            s = codes[i] % 16
        return cost, state, codes, after


EDITS = "conv_id long, pos long, edit string, inserted string, given string, cost long"
#: The place of the row that stands for a conversation's end.
END = 2**62


def _decide(batches) -> Iterator:
    """Rows (conv_id, pos, dropped, initial, must_go, truncated) in order, to EDITS."""
    import pyarrow as pa

    names = ["conv_id", "pos", "edit", "inserted", "given", "cost"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def edits(conv, dp):
        cost, state, codes, after = dp.end()
        for i, (code, now) in enumerate(zip(codes, after)):
            kind, before = divmod(code, 16)
            yield conv, i + 1, "DKR"[kind], BETWEEN[before, now] if kind else "", GIVEN[now] if kind == 2 else None, None
        yield conv, END, "", AT_END[state], None, cost

    held, rows = None, []
    for batch in batches:
        for conv, _, dropped, initial, must_go, truncated in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[0] != conv:
                for row in edits(*held) if held else ():
                    rows.append(row)
                    if len(rows) == 8192:
                        yield batch_of(rows)
                        rows = []
                held = (conv, Programme())
            if not dropped:
                held[1].row(initial, must_go, truncated)
    for row in edits(*held) if held else ():
        rows.append(row)
        if len(rows) == 8192:
            yield batch_of(rows)
            rows = []
    if rows:
        yield batch_of(rows)


def decisions(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit K, R or D, inserted before: initials, given: the new role, cost) of each row of ``judged`` that isn't
    dropped, and one row at END with what is inserted last and the cost. Only places, initials and faults are shuffled."""
    small = rows.select("conv_id", "pos", "dropped", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_decide, EDITS)


MERGED = ("conv_id", "pos", "edit", "inserted", "given", "cost", "dropped", "turn", "role", "text", "blank", "duplicate", "truncated")


def merged(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (those with ``dropped``), each after its decision, by conversation and place: one shuffle of the texts."""
    blank = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in ("conv_id", "pos")]
    both = edits.select("*", *blank(rows)).select(*MERGED).unionByName(rows.select("*", *blank(edits)).select(*MERGED))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("dropped").asc_nulls_first())


def _walk(batches) -> Iterator[tuple]:
    """(conversation, decision or None, row or None) in order; a few rows at a time are Python objects."""
    decision = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for conv, pos, edit, inserted, given, cost, *row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                if row[0] is None:
                    decision = (edit, inserted, given, cost)
                    if pos == END:
                        yield conv, decision, None
                else:
                    yield conv, None if row[0] else decision, row


def _lines(decision: tuple, row: list | None) -> Iterator[tuple[str, str, str]]:
    """What a decision puts in place of a row: (role, text, edit)."""
    edit, inserted, given, _ = decision
    yield from ((ROLES[i], "", "I") for i in inserted)
    if edit in ("K", "R"):
        yield given or row[2], row[3], edit


def _repaired(batches) -> Iterator:
    import pyarrow as pa

    names, types = ["conv_id", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, at, place = [], object(), 0
    for conv, decision, row in _walk(batches):
        if conv != at:
            at, place = conv, 0
        for line in _lines(decision, row) if decision else ():
            out.append((conv, place, *line))
            place += 1
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


class _Summary:
    """The digest of one conversation, fed row by row."""

    def __init__(self):
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before, self.audit, self.lines, self.hash = None, bytearray(), 0, hashlib.sha256()

    def add(self, decision: tuple | None, row: list | None) -> None:
        if row and not row[0]:
            _, turn, role, _, blank, duplicate, truncated = row
            if turn is not None:
                self.turns += self.last != turn  # rows come by turn
                self.first, self.last = turn if self.first is None else self.first, turn
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
        if decision:
            self.audit += ("I" * len(decision[1]) + decision[0]).encode()
            self.cost += decision[3] or 0
            for role, text, _ in _lines(decision, row):
                self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "replace"))
                self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


def _digest(batches) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
    held, out = None, []
    for conv, decision, row in _walk(batches):
        if held is None or held[0] != conv:
            if held:
                out.append((held[0], *held[1].row()))
            held = (conv, _Summary())
        held[1].add(decision, row)
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    if held:
        out.append((held[0], *held[1].row()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _planned(spark: SparkSession, rows: DataFrame) -> DataFrame:
    held = Staged(spark, judged(rows), "turns").df  # read for the programme, then for the texts
    return merged(held, decisions(held))


def repaired(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(conv_id, place from 0, role, text, edit K, R or I): the repaired conversations; ``rows`` as ``judged`` takes them."""
    return _planned(spark, rows).mapInArrow(_repaired, "conv_id long, place long, role string, text string, edit string")


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row a conversation, those whose rows are all dropped included: faults, the cheapest repair's cost and edits, and the
    SHA-256 of its ``role:text`` lines."""
    return _planned(spark, rows).mapInArrow(_digest, DIGEST)


def oracle() -> str:
    """The same as DuckDB SQL: a recursive query that carries, for each state, price, edits and repaired text."""
    step = lambda s, price, letters, lines: f"CASE WHEN {s}.c IS NOT NULL THEN {{'c': {s}.c + {price}, 'a': {s}.a || {letters}, 't': {s}.t || {lines}}} END"
    stay = lambda s: step(s, DELETE, "'D'", "''")
    empty = {"": "", "u": "user:\n", "a": "assistant:\n"}

    def state(name: str, initial: str) -> str:
        target = "_SUA".index(name)
        options = [stay(f"w.{name}")]
        for (a, b), between in BETWEEN.items():
            if b != target:
                continue
            before = "'" + "".join(empty[i] for i in between).replace("\n", "' || chr(10) || '") + "'"
            source, inserts = f"w.{'NSUA'[a]}", "I" * len(between)
            kept = step(source, f"{INSERT * len(between)} + {CUT_OFF} * j.truncated::INTEGER", f"'{inserts}K'", f"{before} || j.role || ':' || j.text || chr(10)")
            options.append(f"CASE WHEN NOT j.blank AND NOT j.duplicate AND left(j.role, 1) = '{initial}' THEN {kept} END")
            if initial != "s":
                moved = step(source, f"{INSERT * len(between) + REROLE} + {CUT_OFF} * j.truncated::INTEGER", f"'{inserts}R'", f"{before} || '{ROLES[initial]}:' || j.text || chr(10)")
                options.append(f"CASE WHEN NOT j.blank AND NOT j.duplicate AND left(j.role, 1) <> '{initial}' THEN {moved} END")
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x.c IS NOT NULL)) AS {name}"

    ends = ", ".join(step(f"w.{'NSUA'[s]}", INSERT * len(x), f"'{'I' * len(x)}'", "'" + "".join(empty[i] for i in x).replace("\n", "' || chr(10) || '") + "'") for s, x in AT_END.items())
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc_table),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, (SELECT unnest([0, 1]) AS k) WHERE h <> 0 AND (k = 0 OR h = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos, NOT regexp_matches(text, '[^ 	-
]') AS blank
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM rows_)),
j AS (SELECT *, NOT blank AND seen > 1 AS duplicate, NOT blank AND seen = 1 AND regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS truncated,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
w(conv_id, pos, N, S, U, A) AS (SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, {none}, {none}, {none} FROM conversations GROUP BY conv_id
  UNION ALL SELECT w.conv_id, j.pos, {stay('w.N')}, {state('S', 's')}, {state('U', 'u')}, {state('A', 'a')} FROM w JOIN j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1),
done AS (SELECT conv_id, list_min(list_filter([{ends}], lambda x: x.c IS NOT NULL)) AS b FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(CASE WHEN b.t = '' THEN '' ELSE left(b.t, length(b.t) - 1) END) AS repaired_sha256
FROM done LEFT JOIN counts ON done.conv_id IS NOT DISTINCT FROM counts.conv_id"""


ORACLE = oracle()
