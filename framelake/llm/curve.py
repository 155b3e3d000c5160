"""Shards along a Hilbert curve through metadata: DataFrame functions only.

Each dimension (a number, a text or a size) is quantised to ``BITS`` bits between its least and largest value over the whole
table, the cells are numbered along the curve, rows are sorted by that number, and the order is cut into runs of equal
counts (law ``rows``: at most one apart). Neighbours on the curve are near in every dimension, so files of a shard have
narrow ranges in all of them and a filter on any skips files (``write``).

Places in the order need no global sort: rows are counted by cell and by 12 further bits of an MD5 of id and text, the counts
are summed up in two levels (at most 2^10 prefixes of the cell number in one task, then within each), and a window numbers
the rows of one count. A cell that holds a third of all rows is therefore split 4,096 ways. Of the texts only size and
checksums leave the scan. Bounds of the dimensions are one row.

A null text has no bytes, a null value lies in the lowest cell of its dimension. Rows that agree in id and text have places
next to each other in either order. ``write`` keeps all columns of its input; its own have names that the input lacks.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from framelake.llm.common import CRC_TABLE, Staged, crc_sql

SHARDS, BITS = 16, 5
#: Dimensions of documents; "size" is the text's.
DIMENSIONS = ("doc_id", "size", "source", "lang")
#: Bits of the cell number below those of the first level of sums; hex digits of the hash that split a cell.
FINE, DIGITS = 10, 3


def measure(name: str, value: Column, type: DataType) -> Column:
    """A whole number that orders as the value does: sizes by octaves in four parts, texts by their first six bytes, times in
    microseconds."""
    if name == "size":
        n = F.length(F.bin(value))
        return (n * 4 + F.call_function("shiftright", F.shiftleft(value, 2), n - 1).bitwiseAND(F.lit(3))).cast("long")
    if isinstance(type, NumericType):
        return value.cast("long")
    if type.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(value.cast("timestamp"))
    return F.conv(F.rpad(F.hex(F.substring(F.encode(value.cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")


def quantised(value: Column, least: int | None, most: int | None, bits: int = BITS) -> Column:
    """0 to 2^bits - 1 between the two bounds; nulls and columns of nothing but nulls are 0."""
    if least is None:
        return F.lit(0)
    wide = lambda x: x.cast("decimal(20,0)")
    cell = F.call_function("div", (wide(value) - wide(F.lit(least))) * F.lit(1 << bits), wide(F.lit(most)) - wide(F.lit(least)) + F.lit(1))
    return F.coalesce(cell.cast("int"), F.lit(0))


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """The number of a cell along the Hilbert curve; ``cells`` are whole numbers of ``bits`` bits.

    Axes are turned level by level into the curve's transposed number (Gray code), whose bits are then interleaved.
    """
    n, levels = len(cells), [1 << b for b in range(bits - 1, -1, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in levels[:-1] for i in range(n)]) if bits > 1 else F.array().cast("array<struct<q:int,i:int>>")

    def turn(x: Column, step: Column) -> Column:
        at, low = F.get(x, step["i"]), step["q"] - 1
        set_ = at.bitwiseAND(step["q"]) != 0
        change = F.get(x, F.lit(0)).bitwiseXOR(at).bitwiseAND(low)
        moved = lambda v, k: F.when(set_, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((k == 0) | (k == step["i"]), v.bitwiseXOR(change)).otherwise(v))
        return F.transform(x, moved)

    turned = F.aggregate(steps, F.array(*[c.cast("int") for c in cells]), turn)
    # running XOR over the axes, then the last one's bits decide a mask for all
    gray = F.get(F.transform(F.array(turned), lambda x: F.transform(x, lambda v, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda acc, y: acc.bitwiseXOR(y)))), F.lit(0))
    mask = lambda last: F.aggregate(F.array(*map(F.lit, levels)), F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    masked = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(mask(F.element_at(g, -1)))))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    number = lambda x: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + F.call_function("shiftright", F.get(x, p["i"]), p["b"]).bitwiseAND(F.lit(1)))
    return F.get(F.transform(masked, number), F.lit(0))


def measured(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Documents with their text's size and checksum, the dimensions' measures (``_m0``, ...) and the hash that orders a cell."""
    types = {f.name: f.dataType for f in docs.schema.fields}
    octets = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.withColumns({"_size": F.octet_length(octets).cast("long") + 1, "_crc": F.crc32(octets)})
    rows = rows.withColumns({f"_m{i}": measure(d, F.col("_size" if d == "size" else d), types.get(d)) for i, d in enumerate(dimensions)})
    return rows.withColumn("_hash", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_crc").cast("string")).cast("binary")))


def placed(rows: DataFrame, narrow: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Measured rows with curve, shard and slot. ``narrow``: the same rows, of which only measures and hash are read, twice."""
    dims = [c for c in narrow.columns if c.startswith("_m")]
    bounds = narrow.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in dims for f, k in ((F.min, "a"), (F.max, "z"))]).first()  # one row
    cell = hilbert([quantised(F.col(c), bounds[f"{c}a"], bounds[f"{c}z"], bits) for c in dims], bits)
    known = lambda df: df.withColumn("curve", cell).withColumn("_part", F.substring("_hash", 1, DIGITS))
    counts = known(narrow).groupBy("curve", "_part").agg(F.count("*").alias("_n")).withColumn("_coarse", F.call_function("shiftright", F.col("curve"), F.lit(FINE)))
    upto = lambda w: F.sum("_n").over(w) - F.col("_n")
    coarse = counts.groupBy("_coarse").agg(F.sum("_n").alias("_n"))  # at most 2^(dimensions * bits - FINE) rows
    coarse = coarse.select("_coarse", upto(Window.orderBy("_coarse")).alias("_before"))
    starts = counts.withColumn("_start", upto(Window.partitionBy("_coarse").orderBy("curve", "_part"))).join(coarse.hint("merge"), "_coarse")
    starts = starts.select(F.col("curve").alias("_c"), F.col("_part").alias("_p"), (F.col("_start") + F.col("_before")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("curve", "_part").orderBy("_hash", "doc_id"))
    out = known(rows).withColumn("_own", own).join(starts.hint("merge"), (F.col("curve") == F.col("_c")) & (F.col("_part") == F.col("_p")))
    rank, n = F.col("_start") + F.col("_own") - 1, F.lit(bounds["n"])
    shard = F.call_function("div", rank * shards, n)
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", rank - F.call_function("div", F.col("shard").cast("long") * n + shards - 1, F.lit(shards).cast("long")))
    return out.drop("_c", "_p", "_start", "_own", "_part")


def plan(spark: SparkSession, docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every document; texts are read once."""
    rows = measured(docs.select("text", "doc_id", *[d for d in dimensions if d not in ("size", "doc_id")]), dimensions)
    held = Staged(spark, rows.select("doc_id", "_size", "_crc", "_hash", *[c for c in rows.columns if c.startswith("_m")]), "shards").df
    return placed(held, held, shards).select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(spark: SparkSession, docs: DataFrame, path: str, files: int = 64, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS) -> None:
    """The documents as Parquet in folders ``shard=...``, in the curve's order; about ``files`` files. Texts are shuffled twice:
    to their places, and into files."""
    bare = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    needed = ["text", "doc_id", *[d for d in dimensions if d not in ("size", "doc_id")]]
    rows = measured(bare.select("*", *[F.col(at[c]).alias(c) for c in needed]), dimensions)
    out = placed(rows, rows, shards).repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    free = next(n for n in ("shard", "shard_", "shard__", "shard___") if n.lower() not in {c.lower() for c in docs.columns})
    out.select(*[F.col(at[c]).alias(c) for c in docs.columns], F.col("shard").alias(free)).write.partitionBy(free).parquet(path)


def oracle(bits: int = BITS) -> str:
    """The same as DuckDB SQL, the curve's steps as subqueries."""
    n, levels = len(DIMENSIONS), [1 << b for b in range(bits - 1, -1, -1)]
    body = "SELECT *, " + ", ".join(f"coalesce((m{i}::HUGEINT - a{i}) * {1 << bits} // (z{i}::HUGEINT - a{i} + 1), 0)::INTEGER AS x{i}" for i in range(n)) + " FROM m, bounds"
    for q in levels[:-1]:
        for i in range(n):
            if i:
                body = f"SELECT * REPLACE (CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, xor(x0, x{i}) & {q - 1}) END AS x0, CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {q - 1}) END AS x{i}) FROM ({body})"
            else:
                body = f"SELECT * REPLACE (CASE WHEN x0 & {q} <> 0 THEN xor(x0, {q - 1}) ELSE x0 END AS x0) FROM ({body})"
    for i in range(1, n):
        body = f"SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM ({body})"
    mask = "0"
    for q in levels:
        mask = f"xor({mask}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    body = f"SELECT * REPLACE ({', '.join(f'xor(x{i}, mask) AS x{i}' for i in range(n))}) FROM (SELECT *, {mask} AS mask FROM ({body}))"
    number = " + ".join(f"((x{i} >> {b}) & 1)::BIGINT * {1 << (b * n + n - 1 - i)}" for b in range(bits - 1, -1, -1) for i in range(n))
    text = lambda c: f"('0x' || rpad(left(hex(encode({c})), 12), 12, '0'))::BIGINT"
    octaves = "4 * length(bin(size)) + (((size << 2) >> (length(bin(size)) - 1)) & 3)"
    return rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {crc_sql("coalesce(text, '')")} AS crc FROM documents, crc_table),
m AS (SELECT doc_id, size, crc, md5(coalesce(doc_id::VARCHAR, '') || ':' || crc) AS h, doc_id AS m0, {octaves} AS m1, {text('source')} AS m2, {text('lang')} AS m3 FROM d),
bounds AS (SELECT count(*) AS n, {', '.join(f'min(m{i}) AS a{i}, max(m{i}) AS z{i}' for i in range(n))} FROM m),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, h, doc_id NULLS FIRST) - 1 AS r FROM (SELECT *, {number} AS curve FROM ({body})))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (r * {SHARDS} // n)::INTEGER AS shard, (r - ((r * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve FROM ranked"""


ORACLE = oracle()
