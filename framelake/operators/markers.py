"""Markers of a web map: points within a radius of pixels stand behind one marker, zoom by zoom.

The points are taken in a fixed order, that of the MD5 of their ids. One that has no earlier marker within the radius becomes
a marker; when all are decided, each other point goes to its nearest marker. So no two markers are within the radius of each
other, and no point is farther than it from its own.

Cells are squares whose diagonal is the radius: points of one cell are all within it, so a cell holds at most one marker, and
its next candidate is its first undecided point. In each round the candidates that come first among those of the 24
cells around them become markers, and points within their radius are decided. That is the result of the ordered walk; a
round costs one aggregation and one join that are linear in the undecided points, and as the order is that of a hash, the
rounds grow with the logarithm of the occupied cells, also where ids follow a route.

Edge cases: rows without a coordinate or an id take no part; points of equal coordinates are one point, that of its smallest
id; latitudes beyond the square map are drawn at its edge; distances don't wrap around the date line; no rows, no markers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.tables import staged

#: The radius in pixels, and the pixels of a tile.
RADIUS, TILE = 60, 256
#: The latitude at which a map in Mercator's projection is square.
EDGE = 85.0511287798


def projected(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Pixels from the upper left corner of the world."""
    world = TILE * 2**zoom
    turn = F.radians(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), lat)))
    return (lng + 180) / 360 * world, (0.5 - F.log(F.tan(turn) + 1 / F.cos(turn)) / (2 * F.pi())) * world


def _apart(x: Column, y: Column, m: Column) -> Column:
    """Squared distance, rounded so that the order of sums doesn't decide."""
    return F.round((x - m["x"]) * (x - m["x"]) + (y - m["y"]) * (y - m["y"]), 6)


def _around(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(cx, cy, name) in the cell of each row and the 24 cells that the radius can reach from it."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)])
    return rows.select("cx", "cy", value.alias(name), F.explode(steps).alias("s")).select((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), name)


def chosen(spark: SparkSession, points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(id, x, y, cx, cy): the markers among points (id, x, y, cx, cy) of different places."""
    turn = F.struct(F.md5(F.col("id").cast("string").cast("binary")).alias("turn"), "id", "x", "y")
    rest, found = staged(spark, points.select("cx", "cy", turn.alias("p")), "undecided"), []
    while True:
        first = rest.groupBy("cx", "cy").agg(F.min("p").alias("p"))
        least = _around(first, F.struct("p.turn", "p.id"), "least").groupBy("cx", "cy").agg(F.min("least").alias("least"))
        new = staged(spark, first.join(least, ["cx", "cy"]).where("p.turn = least.turn and p.id = least.id").select("cx", "cy", "p"), "markers")
        found.append(new)
        if new.isEmpty():
            break
        # few a cell: markers are further apart than the radius
        near = _around(new, F.struct("p.x", "p.y"), "m").groupBy("cx", "cy").agg(F.collect_list("m").alias("near"))
        taken = F.exists(F.coalesce("near", F.array()), lambda m: _apart(F.col("p.x"), F.col("p.y"), m) <= radius * radius)
        rest = staged(spark, rest.join(near, ["cx", "cy"], "left").where(~taken).select("cx", "cy", "p"), "undecided")
    out = found[0]
    for new in found[1:-1]:
        out = out.unionByName(new)
    return out.select("p.id", "p.x", "p.y", "cx", "cy")


def clustered(spark: SparkSession, rows: DataFrame, zoom: int, radius: float = RADIUS) -> DataFrame:
    """(id, lat, lng, n, marker_id) of each place among rows (id, lat, lng and, if given, n: how many rows one stands for)."""
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    whole = rows.where("id is not null and lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    x, y = projected(F.col("lat"), F.col("lng"), zoom)
    side = radius / 2**0.5
    places = whole.groupBy("lat", "lng").agg(F.min("id").alias("id"), n.alias("n")).withColumn("x", x).withColumn("y", y)
    places = staged(spark, places.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)), "places")
    marks = chosen(spark, places, radius)
    near = _around(marks, F.struct("id", "x", "y"), "m").groupBy("cx", "cy").agg(F.collect_list("m").alias("near"))
    nearest = F.array_min(F.transform("near", lambda m: F.struct(_apart(F.col("x"), F.col("y"), m).alias("d"), m["id"].alias("id"))))
    return places.join(near, ["cx", "cy"]).select("id", "lat", "lng", "n", nearest["id"].alias("marker_id"))


def markers(places: DataFrame) -> DataFrame:
    """(id, lat, lng, n, places): each marker at its own place, with the rows and places behind it."""
    own = F.col("id") == F.col("marker_id")
    at = [F.max(F.when(own, F.col(c))).alias(c) for c in ("lat", "lng")]
    return places.groupBy(F.col("marker_id")).agg(*at, F.sum("n").alias("n"), F.count("*").alias("places")).withColumnRenamed("marker_id", "id")


def pyramid(spark: SparkSession, rows: DataFrame, finest: int = 12, coarsest: int = 2, radius: float = RADIUS) -> Iterator[tuple[int, DataFrame]]:
    """(zoom, markers) from the finest zoom to the coarsest; each level is made of the markers of the one before, so the work
    after the first level is that of its markers."""
    for zoom in range(finest, coarsest - 1, -1):
        level = staged(spark, markers(clustered(spark, rows, zoom, radius)), "level")
        yield zoom, level
        rows = level.drop("places")
