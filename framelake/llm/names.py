"""Names that differ by one edit: partitioned neighbourhoods.

A name is cut into three pieces. One edit (insertion, deletion, substitution of a code point, exchange of two adjacent
ones) is at most two plain edits, so of the three pieces one surely has at most one of them: in names of equal length some
piece equals the other name's substring at the same place or differs from it by one substitution, and both lose the same
code point to one and the same rest; in names whose lengths differ by one, the first piece is whole at its place or the
last one is whole, shifted by one. These pieces and rests are the keys of a join; whole names are compared in the join's
own condition, so nothing but true pairs leaves it.

Names are what is compared: each distinct name has one row, whatever number of rows bears it, so a name that a third of all
rows has costs no more than another. Keys that many different names share (a common first name) are dealt to ``PARTS`` parts
by the longer table's name, and the other table's keys are copied to all. Nothing is collected or broadcast: the joins are
sort-merge joins. Work follows the names that share a piece and a length, which grows with both tables' distinct names.

Null names, and names with nothing but spaces, take no part; null ids count as rows, but have no part in sums and minima.
Names of one or two code points have empty pieces, so they meet all names of their length. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import CRC_TABLE, crc_sql

#: Parts of a key of the left table; keys of the right table have a copy in each.
PARTS = 4
#: Parts of a right name's rows when results go back to them.
SPREAD = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def compared(name: Column) -> Column:
    """A-Z in lower case, without white space; null where nothing is left."""
    return F.nullif(F.translate(F.regexp_replace(name, r"[\x20\x09-\x0D]", ""), UPPER, LOWER), F.lit(""))


def crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def misspelt(name: Column, id: Column) -> Column:
    """Two neighbouring code points change places where the id's checksum is even; it says which."""
    h, n = crc(id), F.length(name)
    at = (h % F.when(n > 1, n - 1)).cast("int")  # from 0
    part = lambda start, length: F.substr(name, start, length)
    swapped = F.concat(part(F.lit(1), at), part(at + 2, F.lit(1)), part(at + 1, F.lit(1)), part(at + 3, n))
    return F.when((h % 2 == 0) & (n > 1), swapped).otherwise(name)


def pieces(n: Column) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the three pieces of a name of n code points."""
    cut = [F.floor(n * i / 3).cast("int") for i in range(4)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(3)]


def keys(name: Column, other: int, owner: bool) -> Column:
    """64-bit keys under which names of length n (the owner of the pieces) meet names of length n + other.

    Of equal lengths: every piece without each of its code points in turn. Else the first piece as it is, and the last as
    it is; in the name that doesn't own the pieces the last one is shifted by ``other``.
    """
    n = F.length(name) if owner else F.length(name) - other
    found = pieces(n)
    key = lambda i, at, rest: F.xxhash64(n, F.lit(other), F.lit(i), at, rest)
    if other:
        ends = []
        for i in (0, 2):
            start, length = found[i]
            shift = 0 if owner or i == 0 else other
            ends.append(key(i, F.lit(-1), F.substr(name, start + shift + 1, length)))
        return F.when(n > 0, F.array(*ends)).otherwise(F.array().cast("array<long>"))

    def rests(i: int, start: Column, length: Column) -> Column:
        without = lambda p: key(i, p, F.concat(F.substr(name, start + 1, p), F.substr(name, start + p + 2, length - p - 1)))
        # no code point can go from an empty piece
        return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), without)).otherwise(F.array().cast("array<long>"))

    return F.concat(*[rests(i, *piece) for i, piece in enumerate(found)])


def distance(a: Column, b: Column) -> Column:
    """0 or 1; null for names further apart."""
    plain = F.levenshtein(a, b, 2)
    apart = F.filter(F.sequence(F.lit(1), F.length(a)), lambda p: F.substr(a, p, F.lit(1)) != F.substr(b, p, F.lit(1)))
    first = F.get(apart, 0)
    one = lambda s, p: F.substr(s, p, F.lit(1))
    exchanged = (F.size(apart) == 2) & (F.get(apart, 1) == first + 1) & (one(a, first) == one(b, first + 1)) & (one(a, first + 1) == one(b, first))
    return F.when(plain.isin(0, 1), plain).when((plain == 2) & (F.length(a) == F.length(b)) & exchanged, F.lit(1))


def close_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name, distance) of all pairs of the distinct names of two tables (name) at distance 0 or 1."""
    l_keys = F.concat(*[keys(F.col("l"), d, False) for d in (-1, 0, 1)])
    r_keys = F.concat(*[keys(F.col("r"), d, True) for d in (-1, 0, 1)])
    lefts = left.select(F.col("name").alias("l")).where("l <> ''").distinct()
    lefts = lefts.select("l", F.explode(l_keys).alias("k"), F.pmod(F.xxhash64("l"), F.lit(PARTS)).cast("int").alias("part"))
    rights = right.select(F.col("name").alias("r")).where("r <> ''").distinct().select("r", F.explode(r_keys).alias("k"))
    rights = rights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & distance(F.col("l"), F.col("r")).isNotNull()
    met = rights.alias("b").join(lefts.alias("a").hint("merge"), on).select("l", "r").distinct()  # a pair meets under several keys
    return met.select(F.col("l").alias("left_name"), F.col("r").alias("right_name"), distance(F.col("l"), F.col("r")).alias("distance"))


def matches(clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row a vendor and distance (0 or 1) at which clients are found: how many, the smallest id, and their checksum.

    ``clients`` (client_id, name) and ``vendors`` (vendor_id, name), names as they are to be compared. Pairs of names
    carry counts of rows, not rows; the results go back to a name's vendors in ``SPREAD`` parts.
    """
    bearers = clients.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("least"), F.coalesce(F.sum(crc(F.col("client_id"))), F.lit(0)).alias("sum"))
    pairs = close_names(clients, vendors)
    found = pairs.join(bearers.hint("merge"), F.col("left_name") == F.col("name")).groupBy("right_name", "distance")
    found = found.agg(F.sum("n").alias("n_clients"), F.min("least").alias("first_client_id"), F.sum("sum").alias("clients_crc"))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    asked = vendors.select("vendor_id", F.col("name").alias("right_name")).where("right_name <> ''")
    asked = asked.withColumn("part", F.coalesce(F.pmod(F.xxhash64("vendor_id"), F.lit(SPREAD)).cast("int"), F.lit(0)))
    out = asked.join(found.hint("merge"), ["right_name", "part"])
    return out.select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc", F.col("right_name").alias("compared_name"))


ORACLE = rf"""
WITH {CRC_TABLE},
c AS (SELECT client_id, nullif(translate(regexp_replace(name, '[\x20\x09-\x0D]', '', 'g'), '{UPPER}', '{LOWER}'), '') AS name FROM clients),
v0 AS (SELECT vendor_id, name, length(name) AS n, coalesce({crc_sql('vendor_id::VARCHAR')}, 1) AS h FROM vendors, crc_table),
v1 AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND n > 1 THEN substr(name, 1, h % (n - 1)) || substr(name, h % (n - 1) + 2, 1) || substr(name, h % (n - 1) + 1, 1) || substr(name, h % (n - 1) + 3) ELSE name END AS name FROM v0),
v AS (SELECT vendor_id, nullif(translate(regexp_replace(name, '[\x20\x09-\x0D]', '', 'g'), '{UPPER}', '{LOWER}'), '') AS name FROM v1),
p AS (SELECT vendor_id, client_id, v.name AS a, c.name AS b, length(v.name) AS n, length(c.name) AS m,
  len(list_filter(range(1, least(length(v.name), length(c.name)) + 1), lambda i: left(v.name, i) = left(c.name, i))) AS s
  FROM v JOIN c ON abs(length(v.name) - length(c.name)) <= 1),
d AS (SELECT vendor_id, client_id, CASE WHEN a = b THEN 0
  WHEN n = m AND (substr(a, s + 2) = substr(b, s + 2) OR substr(a, s + 1, 1) = substr(b, s + 2, 1) AND substr(a, s + 2, 1) = substr(b, s + 1, 1) AND substr(a, s + 3) = substr(b, s + 3)) THEN 1
  WHEN n = m + 1 AND substr(a, s + 2) = substr(b, s + 1) OR m = n + 1 AND substr(b, s + 2) = substr(a, s + 1) THEN 1 END AS distance FROM p)
SELECT vendor_id, distance::INTEGER AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, coalesce(sum({crc_sql('client_id::VARCHAR')}), 0)::BIGINT AS clients_crc
FROM d, crc_table WHERE distance IS NOT NULL GROUP BY vendor_id, distance"""
