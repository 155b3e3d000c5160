"""People kept up by the differences of their faces.

Of each person are kept: the number of its faces, the sum of their vectors, its best faces (KEPT at most, best quality first, then
confidence, then smallest id) and a floor: every face that is not listed ranks below it; null if all faces are listed.
Faces that go are subtracted and leave the list, which stays right as it gets shorter; faces that come are added, and
listed if they reach the floor. Only where a list is used up while faces are left are that person's faces read again.

The people lie in folders by hash of the id. A change reads and writes the folders of the people that it touches and appears
as a whole (``Versions``); a change beside another is refused.

Edge cases: faces without a person take no part; a person without faces is gone; a face that changes within one person is given
with that person before and after; a null quality or confidence ranks last; null vectors count as faces and add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources.tables import staged
from framelake.sources.versions import Versions

KEPT, BUCKETS = 8, 64
ITEM = "struct<quality:double,confidence:double,back:bigint>"
SCHEMA = f"person_id long, n long, total array<double>, best array<{ITEM}>, floor {ITEM}"


def _item() -> Column:
    """A face in its rank: the larger, the better."""
    return F.struct(F.col("quality").cast("double").alias("quality"), F.col("confidence").cast("double").alias("confidence"), (-F.col("face_id")).cast("long").alias("back"))


def _sums(rows: DataFrame) -> DataFrame:
    """(person_id, n, total) from (person_id, sign, n, vector); sums by coordinate are combined before the shuffle."""
    x = F.col("x").cast("double") * F.col("sign")
    by = rows.select("person_id", "sign", F.posexplode("vector").alias("pos", "x")).groupBy("person_id", "pos").agg(F.sum(x).alias("x"))
    total = by.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))
    return rows.groupBy("person_id").agg(F.sum("n").alias("n")).join(total, "person_id", "left")


def _listed(items: DataFrame, floors: DataFrame) -> DataFrame:
    """(person_id, best, floor) from (person_id, item) and (person_id, floor): the best of the items that reach the floor."""
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("item")))
    top = items.withColumn("rank", rank).where(F.col("rank") <= KEPT + 1).groupBy("person_id").agg(F.sort_array(F.collect_list("item"), asc=False).alias("top"))
    both = top.join(floors, "person_id", "full").withColumn("top", F.filter(F.coalesce("top", F.array().cast(f"array<{ITEM}>")), lambda i: F.col("floor").isNull() | (i >= F.col("floor"))))
    best = F.slice("top", 1, KEPT)
    return both.select("person_id", best.alias("best"), F.when(F.size("top") > KEPT, F.get("top", F.lit(KEPT - 1))).otherwise(F.col("floor")).alias("floor"))


def state_of(faces: DataFrame) -> DataFrame:
    """The state of all people, from all faces (face_id, person_id, quality, confidence, embedding)."""
    own = faces.where("person_id is not null")
    items = own.select("person_id", _item().alias("item"))
    floors = own.select("person_id").distinct().withColumn("floor", F.lit(None).cast(ITEM))
    rows = own.select("person_id", F.lit(1).alias("sign"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("vector"))
    return _ordered(_sums(rows).join(_listed(items, floors), "person_id"))


def changed(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The people that changes (face_id, before, after, quality, confidence, embedding) touch, as they are then; ``state`` holds
    their rows before, and may hold others, which are left out. Null before: the face is new; null after: it is gone."""
    side = lambda c, sign: changes.where(F.col(c).isNotNull()).select(F.col(c).alias("person_id"), F.lit(sign).alias("sign"), F.lit(sign).cast("long").alias("n"), F.col("embedding").alias("vector"))
    delta = _sums(side("before", -1).unionByName(side("after", 1))).withColumnsRenamed({"n": "more", "total": "shift"})
    was = state.join(delta.select("person_id"), "person_id", "left_semi")
    left = changes.where("before is not null").select(F.col("before").alias("person_id"), (-F.col("face_id")).alias("back"))
    stay = was.select("person_id", F.explode("best").alias("item")).withColumn("back", F.col("item.back")).join(left, ["person_id", "back"], "left_anti").drop("back")
    come = changes.where("after is not null").select(F.col("after").alias("person_id"), _item().alias("item"))
    listed = _listed(stay.unionByName(come), was.select("person_id", "floor"))
    out = delta.join(was.select("person_id", "n", "total"), "person_id", "left").join(listed, "person_id", "left")
    n, zero = F.coalesce("n", F.lit(0)) + F.col("more"), F.array().cast("array<double>")
    total = F.zip_with(F.coalesce("total", zero), F.coalesce("shift", zero), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return _ordered(out.withColumns({"n": n, "total": total, "best": F.coalesce("best", F.array().cast(f"array<{ITEM}>"))}))


def joined(state: DataFrame, mapping: DataFrame) -> DataFrame:
    """The people that others were merged into by mapping (from_id, into_id), none of them in both columns; ``state`` holds them all."""
    into = mapping.select(F.col("from_id").alias("person_id"), "into_id").unionByName(mapping.select(F.col("into_id").alias("person_id"), "into_id")).distinct()
    parts = state.join(into, "person_id").drop("person_id").withColumnRenamed("into_id", "person_id")
    floors = parts.groupBy("person_id").agg(F.max("floor").alias("floor"))
    listed = _listed(parts.select("person_id", F.explode("best").alias("item")), floors)
    return _ordered(_sums(parts.select("person_id", F.lit(1).alias("sign"), "n", F.col("total").alias("vector"))).join(listed, "person_id"))


def refilled(rows: DataFrame, faces: DataFrame) -> DataFrame:
    """Lists that are used up are made anew from the person's faces; no other person's faces take part."""
    empty = rows.where("n > 0 and size(best) = 0").select("person_id")
    items = faces.join(empty, "person_id", "left_semi").select("person_id", _item().alias("item"))
    new = _listed(items, empty.withColumn("floor", F.lit(None).cast(ITEM))).withColumnsRenamed({"best": "best2", "floor": "floor2"})
    pick = lambda a, b: F.when(F.col("best2").isNotNull(), F.col(b)).otherwise(F.col(a)).alias(a)
    return _ordered(rows.join(new, "person_id", "left").select("person_id", "n", "total", pick("best", "best2"), pick("floor", "floor2")))


def shown(state: DataFrame) -> DataFrame:
    """(person_id, n, centroid, cover_face_id, covers): the unit mean vector and the best faces of each person."""
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x))
    unit = state.withColumn("len", F.when(length == 0, 1.0).otherwise(length))
    ids = F.transform("best", lambda i: -i["back"])
    return unit.select("person_id", "n", F.transform("total", lambda x: x / F.col("len")).alias("centroid"), F.get(ids, F.lit(0)).alias("cover_face_id"), ids.alias("covers"))


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.col("person_id").cast("long").alias("person_id"), F.col("n").cast("long").alias("n"), F.coalesce("total", F.array().cast("array<double>")).alias("total"), F.col("best").cast(f"array<{ITEM}>").alias("best"), F.col("floor").cast(ITEM).alias("floor"))


class PeopleState:
    """The people of a catalogue below a folder that executors and drivers share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.versions, self.buckets = spark, Versions(spark, path), buckets

    def build(self, faces: DataFrame) -> None:
        self._write(self.versions.latest(), state_of(faces), range(self.buckets))

    def change(self, changes: DataFrame, faces: DataFrame) -> None:
        """``faces`` are those after the changes; they are read for people whose list is used up."""
        base, changes = self.versions.latest(), staged(self.spark, changes, "changes")
        touched = changes.select(F.explode(F.array("before", "after")).alias("person_id")).where("person_id is not null").distinct()
        hit = self._hit(touched)
        old = self._read(base, hit)
        new = staged(self.spark, changed(old, changes), "touched")
        if not new.where("n > 0 and size(best) = 0").isEmpty():
            new = refilled(new, faces)
        self._write(base, old.join(touched, "person_id", "left_anti").unionByName(new.where("n > 0")), hit)

    def merge(self, mapping: DataFrame) -> None:
        base = self.versions.latest()
        touched = mapping.select(F.explode(F.array("from_id", "into_id")).alias("person_id")).distinct()
        hit = self._hit(touched)
        old = self._read(base, hit)
        self._write(base, old.join(touched, "person_id", "left_anti").unionByName(joined(old, mapping)), hit)

    def people(self) -> DataFrame:
        return shown(self._read(self.versions.latest(), range(self.buckets)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("person_id").cast("long")), F.lit(self.buckets)).cast("int")

    def _hit(self, touched: DataFrame) -> list[int]:
        """The buckets of the people, ``buckets`` numbers at most."""
        return sorted(r[0] for r in touched.select(self._bucket()).distinct().collect())

    def _read(self, base: int, buckets) -> DataFrame:
        tables = self.versions.manifest(base)["tables"]
        paths = [tables[f"people-{b}"] for b in buckets if f"people-{b}" in tables]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _write(self, base: int, rows: DataFrame, buckets) -> None:
        at = self.versions.written(rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("person_id", F.lit(1)), F.lit(16))), "people", "bucket")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        names = {f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)}
        self.versions.commit(base, {f"people-{b}": f"{at}/bucket={b}" if f"bucket={b}" in names else None for b in buckets})
