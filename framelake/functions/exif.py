"""Size, time and place of a photo from the bytes of its file: headers only, no pixels are decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from framelake.functions.media import kind_of

#: Tags of the formats.
WIDTH, HEIGHT, EXIF, GPS, TAKEN, LAT_REF, LAT, LNG_REF, LNG = 0x100, 0x101, 0x8769, 0x8825, 0x9003, 1, 2, 3, 4
#: Bytes and struct codes of a field's types.
FIELD = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii")}
#: Markers of a JPEG frame header.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
META = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("taken_at", StringType()), StructField("lat", DoubleType()), StructField("lng", DoubleType())])


def tags(data: bytes, at: int, order: str) -> dict[int, object]:
    """Values of one directory of a TIFF structure: a number, a list of numbers, or text."""
    (n,) = struct.unpack_from(order + "H", data, at)
    out: dict[int, object] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in FIELD or count > 64:
            continue
        size, code = FIELD[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind == 2:
            out[tag] = data[place : place + count].split(b"\0")[0].decode("ascii", "replace")
            continue
        values = struct.unpack_from(order + code * count, data, place)
        if len(code) == 2:
            values = tuple(a / b if b else None for a, b in zip(values[::2], values[1::2]))
        out[tag] = values[0] if count == 1 else list(values)
    return out


def degrees(parts: object, side: object, negative: str) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(side).upper().startswith(negative) else value


def tiff(data: bytes) -> dict:
    """What a TIFF structure, alone or within another format, says of the photo."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return {}
    top = tags(data, struct.unpack_from(order + "I", data, 4)[0], order)
    inner = tags(data, top[EXIF], order) if isinstance(top.get(EXIF), int) else {}
    place = tags(data, top[GPS], order) if isinstance(top.get(GPS), int) else {}
    taken, lat, lng = str(inner.get(TAKEN, "")), degrees(place.get(LAT), place.get(LAT_REF), "S"), degrees(place.get(LNG), place.get(LNG_REF), "W")
    stamp = taken[:10].replace(":", "-") + "T" + taken[11:19] + ".000Z" if len(taken) >= 19 and taken[:4].isdigit() and taken[:4] != "0000" else None
    return {"width": top.get(WIDTH), "height": top.get(HEIGHT), "taken_at": stamp, "lat": lat if lng is not None else None, "lng": lng if lat is not None else None}


def jpeg(data: bytes) -> dict:
    out, size, at = {}, {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not out:
            try:
                out = tiff(data[at + 10 : at + 2 + length])
            except (struct.error, IndexError):
                out = {}
        elif marker in FRAMES:
            size["height"], size["width"] = struct.unpack_from(">HH", data, at + 5)
        if marker == 0xDA:
            break
        at += 2 + length
    return out | size


def png(data: bytes) -> dict:
    width, height = struct.unpack_from(">II", data, 16)
    out, at = {}, 8
    while at + 8 <= len(data):
        length, name = struct.unpack_from(">I4s", data, at)
        if name == b"eXIf":
            try:
                out = tiff(data[at + 8 : at + 8 + length])
            except (struct.error, IndexError):
                out = {}
            break
        at += 12 + length
    return out | {"width": width, "height": height}


def photo_meta(data: bytes | None) -> dict:
    """width, height, taken_at (UTC is assumed, as the formats have no zone), lat, lng; nulls for what isn't there."""
    data = bytes(data or b"")
    try:
        if data[:2] == b"\xff\xd8":
            found = jpeg(data)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            found = png(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            found = tiff(data)
        elif data[:4] == b"GIF8":
            found = dict(zip(("width", "height"), struct.unpack_from("<HH", data, 6)))
        elif data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            found = {"width": w, "height": abs(h)}
        else:
            found = {}
    except (struct.error, IndexError):
        found = {}
    return {f.name: found.get(f.name) for f in META}


@F.pandas_udf(META)
def _photo_meta(contents: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([photo_meta(x) for x in contents], columns=[f.name for f in META])
    return out.astype({"width": "Int32", "height": "Int32", "taken_at": "object", "lat": "Float64", "lng": "Float64"})


def meta_of(content: Column) -> Column:
    return _photo_meta(content)


def photos_below(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, width, height, taken_at, lat, lng of all images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    images = files.where(kind_of(F.col("path")) == "image").select(F.col("path").alias("file_path"), meta_of(F.col("content")).alias("m"))
    return images.select("file_path", "m.*")
