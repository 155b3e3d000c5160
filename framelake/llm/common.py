"""What the corpus operators share: staging in the shared folder, folds, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes between words in the operators' contracts: space and \x09-\x0D.
WORD_SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII characters that are neither letters nor digits become spaces; bytes of non-ASCII characters stay.
TOKEN_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: ASCII characters that are no letters become spaces.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

#: A step of the CRC-32 for each byte, as a DuckDB list in a table of one row.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i::BIGINT)) AS crc_steps)"

_local_dirs: dict[str, str] = {}


def crc_sql(text: str) -> str:
    """DuckDB SQL: the unsigned CRC-32 of a text's UTF-8 bytes, where CRC_TABLE is in FROM."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda x, y: xor(crc_steps[(xor(x, y) & 255) + 1], x >> 8), 4294967295::BIGINT), 4294967295)"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-process session (``local[...]``) may leave it unset; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="framelake-")
    return _local_dirs[app]


class Staged:
    """A table written to the shared folder: its lineage ends there, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no live DataFrame reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    return Staged(spark, df, tag).df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5. Rows of fold 0 are held out; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(TOKEN_SPLIT).split()


def slices(batch, step: int = 256):
    """Parts of an Arrow batch, so that few texts at a time are Python strings."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def sample_ids(docs: DataFrame, key: str, per_key: int, where: Column) -> DataFrame:
    """At most ``per_key`` ids for each value of ``key``, in hash order of the id: bounded however large the table is.

    Rows are thinned by hash before the window, so its shuffle carries a small multiple of the sample only.
    ``key`` must have few values (languages): one row for each is broadcast.
    """
    rows = docs.select("doc_id", key).where(where & F.col("doc_id").isNotNull() & F.col(key).isNotNull())
    order = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit(2**31 - 1))
    most = F.least(F.lit(1.0), (4.0 * per_key + 64) / F.col("n")) * (2**31 - 1)
    limits = rows.groupBy(key).agg(F.approx_count_distinct("doc_id").alias("n")).select(F.col(key).alias("_of"), most.cast("long").alias("_most"))
    thinned = rows.withColumn("_h", order).join(F.broadcast(limits), F.col(key) == F.col("_of")).where("_h <= _most")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_h", "doc_id"))
    ids = thinned.select("doc_id", key, "_h").distinct()
    return ids.withColumn("_r", rank).where(F.col("_r") <= per_key).select("doc_id", key)
