"""Photo metadata from files that are put together byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from framelake.functions import exif

HERE = {"taken_at": "2023-07-09T08:05:04.000Z", "lat": pytest.approx(-33.8575), "lng": pytest.approx(151.215)}


def directory(order, entries, at):
    """Entries (tag, type, count, raw value) as bytes; values of more than four bytes follow the directory."""
    head, tail = struct.pack(order + "H", len(entries)), b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) > 4:
            head += struct.pack(order + "HHII", tag, kind, count, after + len(tail))
            tail += raw
        else:
            head += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return head + b"\0\0\0\0" + tail


def block(order="<", size=False):
    ratio = lambda *v: b"".join(struct.pack(order + "II", int(x * 100), 100) for x in v)
    long = lambda x: struct.pack(order + "I", x)
    top = [(0x100, 4, 1, long(640)), (0x101, 4, 1, long(480))] if size else []
    first = 8
    inner = first + 2 + 12 * (len(top) + 2) + 4
    taken = directory(order, [(0x9003, 2, 20, b"2023:07:09 08:05:04\0")], inner)
    place = inner + len(taken)
    gps = directory(order, [(1, 2, 2, b"S\0"), (2, 5, 3, ratio(33, 51, 27)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(151, 12, 54))], place)
    main = directory(order, [*top, (0x8769, 4, 1, long(inner)), (0x8825, 4, 1, long(place))], first)
    return (b"II*\0" if order == "<" else b"MM\0*") + long(first) + main + taken + gps


def jpeg(body):
    segment = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + (segment(0xE1, b"Exif\0\0" + body) if body else b"") + segment(0xC0, struct.pack(">BHHB", 8, 300, 400, 3)) + b"\xff\xda\0\x02data"


def png(body):
    chunk = lambda n, b: struct.pack(">I4s", len(b), n) + b + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 400, 300, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", body) if body else b"") + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", ["<", ">"])
def test_time_and_place(order):
    for data in (jpeg(block(order)), png(block(order))):
        assert exif.photo_meta(data) == {"width": 400, "height": 300, **HERE}
    assert exif.photo_meta(block(order, size=True)) == {"width": 640, "height": 480, **HERE}


def test_files_without_metadata_and_broken_ones():
    none = {"taken_at": None, "lat": None, "lng": None}
    assert exif.photo_meta(jpeg(None)) == exif.photo_meta(png(None)) == {"width": 400, "height": 300, **none}
    assert exif.photo_meta(b"GIF89a" + struct.pack("<HH", 7, 9)) == {"width": 7, "height": 9, **none}
    assert exif.photo_meta(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == {"width": 5, "height": 6, **none}
    whole = jpeg(block())
    for n in range(len(whole)):  # cut anywhere
        assert set(exif.photo_meta(whole[:n])) == {"width", "height", "taken_at", "lat", "lng"}
    broken = bytearray(whole)
    broken[40:60] = b"\xff" * 20
    assert exif.photo_meta(bytes(broken))["width"] == 400
    assert set(exif.photo_meta(None).values()) == set(exif.photo_meta(b"text").values()) == {None}


def test_photos_below_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.JPG").write_bytes(jpeg(block()))
    (tmp_path / "two.png").write_bytes(png(None))
    (tmp_path / "three.txt").write_text("no image")
    got = {r.file_path.rsplit("/", 1)[1]: r for r in exif.photos_below(spark, str(tmp_path)).collect()}
    assert got.keys() == {"one.JPG", "two.png"}
    assert got["one.JPG"].taken_at == HERE["taken_at"] and got["one.JPG"].lat == HERE["lat"] and got["one.JPG"].width == 400
    assert got["two.png"].taken_at is None and got["two.png"].height == 300
    assert spark.range(1).select(exif.meta_of(F.lit(None).cast("binary")).alias("m")).first().m.width is None
