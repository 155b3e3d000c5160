"""Markers equal an ordered walk over all points, at every level."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import markers

SCHEMA = "id long, lat double, lng double"


def pixels(lat, lng, zoom):
    t = math.radians(max(-markers.EDGE, min(markers.EDGE, lat)))
    world = 256 * 2**zoom
    return (lng + 180) / 360 * world, (0.5 - math.log(math.tan(t) + 1 / math.cos(t)) / (2 * math.pi)) * world


def walk(rows, zoom):
    """id of each place: (lat, lng, n, marker), by brute force."""
    place = {}
    for i, lat, lng, n in rows:
        if None not in (i, lat, lng):
            was = place.get((lat, lng))
            place[lat, lng] = (min(i, was[0]) if was else i, n + (was[1] if was else 0))
    points = {i: (*pixels(lat, lng, zoom), lat, lng, n) for (lat, lng), (i, n) in place.items()}
    far = lambda a, b: round((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2, 6)
    marks = []
    for i in sorted(points, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        if all(far(i, m) > 3600 for m in marks):
            marks.append(i)
    return {i: (*points[i][2:], min((far(i, m), m) for m in marks)[1]) for i in points}


def cases():
    r = random.Random(5)
    town = [(i, 48 + r.random(), 11 + r.random()) for i in range(400)]
    route = [(i, 40 + i / 40, -100 + i / 20) for i in range(400)]  # ids follow the way
    odd = [(1, 90.0, 0.0), (2, -90.0, 0.0), (3, 10.0, 180.0), (4, 10.0, -180.0), (5, None, 1.0), (None, 1.0, 1.0), (7, 10.0, None), (8, 10.0, 180.0), (9, 0.0, 0.0), (9, 0.0, 0.0)]
    spot = [(i, 50.0, 8.0) for i in range(300)] + [(300 + i, 50 + i / 30, 8.0) for i in range(200)]
    return {"town": (town, 9), "route": (route, 5), "odd": (odd, 2), "spot": (spot, 6)}


@pytest.mark.parametrize("name", cases())
def test_markers_equal_the_walk(spark, name):
    rows, zoom = cases()[name]
    got = {r.id: (r.lat, r.lng, r.n, r.marker_id) for r in markers.clustered(spark, spark.createDataFrame(rows, SCHEMA), zoom).collect()}
    want = walk([(*r, 1) for r in rows], zoom)
    assert got == want
    marks = [pixels(*want[i][:2], zoom) for i in {w[3] for w in want.values()}]
    assert all(math.dist(a, b) > 60 for a in marks for b in marks if a is not b)
    assert all(math.dist(pixels(*w[:2], zoom), pixels(*want[w[3]][:2], zoom)) <= 60.001 for w in want.values())


def test_levels_are_made_of_markers(spark):
    rows, last = [(*r, 1) for r in cases()["town"][0]], None
    for zoom, level in markers.pyramid(spark, spark.createDataFrame([r[:3] for r in rows], SCHEMA), 9, 7):
        want = walk(rows, zoom)
        by = {}
        for lat, lng, n, m in want.values():
            by[m] = by.get(m, 0) + n
        assert {r.id: r.n for r in level.collect()} == by and sum(by.values()) == 400
        assert last is None or len(by) <= last
        last = len(by)
        rows = [(r.id, r.lat, r.lng, r.n) for r in level.collect()]


def test_no_points_no_markers(spark):
    assert markers.markers(markers.clustered(spark, spark.createDataFrame([], SCHEMA), 3)).count() == 0


def test_rounds_stay_few_on_a_route(spark, monkeypatch):
    made = []
    monkeypatch.setattr(markers, "staged", lambda s, df, tag: made.append(tag) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    markers.clustered(spark, spark.createDataFrame([(i, 0.0, i / 10) for i in range(1500)], SCHEMA), 6).count()
    assert made.count("markers") <= 12
