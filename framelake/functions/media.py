"""Media expressions and vectorised decoders around models."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from framelake.functions.text import extension

#: Supported extensions by kind.
IMAGE = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif", ".bmp", ".tiff", ".tif", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2", ".avif"]
VIDEO = [".mp4", ".mov", ".m4v", ".webm", ".mkv", ".avi"]
AUDIO = [".mp3", ".m4a", ".aac", ".wav", ".flac", ".ogg", ".opus"]
#: MIME types by extension.
MIME = {
    ".mp4": "video/mp4", ".m4v": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo",
    ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".aac": "audio/aac", ".wav": "audio/wav", ".flac": "audio/flac", ".ogg": "audio/ogg", ".opus": "audio/ogg",
}
SEGMENT_MS = 32_000


def kind_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(IMAGE), "image").when(ext.isin(VIDEO), "video").when(ext.isin(AUDIO), "audio")


def mime_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("application/octet-stream"))


def light_hash(size: Column, mtime: Column, content: Column, edge: int = 65_536) -> Column:
    """Hash of size, time and both ends of the content; the tail counts only if the ends don't overlap."""
    head = F.substring(content, 1, edge)
    tail = F.when(F.octet_length(content) > 2 * edge, F.substring(content, -edge, edge)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.concat_ws("|", F.lit("v1"), size.cast("string"), mtime.cast("string"), F.lit("")).cast("binary"), head, tail), 256)


def segment_hash(video_hash: Column, start: Column, end: Column) -> Column:
    return F.md5(F.concat_ws("_", video_hash, start.cast("string"), end.cast("string")))


def byte_range(header: Column, size: Column) -> Column:
    """struct(status, start, end): 200 whole, 206 part, 416 unsatisfiable."""
    h = F.trim(header)
    form = r"^bytes=(\d*)-(\d*)$"
    a, b = F.regexp_extract(h, form, 1), F.regexp_extract(h, form, 2)
    na, nb = a.try_cast("long"), b.try_cast("long")
    suffix = (a == "") & (b != "")
    start = F.when(suffix, F.greatest(F.lit(0), size - nb)).otherwise(na)
    end = F.when(suffix | (b == ""), size - 1).otherwise(F.least(nb, size - 1))
    bad = ((a == "") & (b == "")) | (suffix & ((nb == 0) | (size == 0))) | (~suffix & ((na >= size) | (end < na)))
    well = h.rlike(form)
    status = F.when(h.isNull() | (h == ""), 200).when(~well, F.when(h.startswith("bytes=") & ~h.contains(","), 416).otherwise(200)).when(bad, 416).otherwise(206)
    return F.struct(status.cast("int").alias("status"), F.when(status == 206, start).cast("long").alias("start"), F.when(status == 206, end).cast("long").alias("end"))


def segments(duration_ms: Column) -> Column:
    """Half-open intervals of 32 s, one at least; the last is clipped."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(duration_ms / SEGMENT_MS))
    at = lambda i: (i * SEGMENT_MS).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(at(i).alias("start_ms"), F.least(at(i + 1), F.greatest(duration_ms, F.lit(0))).cast("long").alias("end_ms")))


def frame_times(start_s: Column, duration_s: Column, interval_s: Column, most: int) -> Column:
    """Milliseconds of the sampled frames of a segment."""
    n = F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(duration_s / interval_s)))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.round((start_s + i * interval_s) * 1000).cast("long"))


def sprite_times(duration_ms: Column, slots: int = 12) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: ((k + 0.5) / slots * duration_ms).cast("double"))


def ramp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


#: Face sizes in pixels, the worst yaw, and sharpness, between which a face's quality runs from 0 to 1.
SIZE_RAMP, YAW_BAD, SHARP_RAMP = (24.0, 72.0), 0.6, (20.0, 120.0)


def face_score(size_px: Column, yaw: Column, sharpness: Column) -> Column:
    """The worst of size, pose and sharpness."""
    return F.least(ramp(size_px, *SIZE_RAMP), 1 - ramp(yaw, 0.0, YAW_BAD), ramp(sharpness, *SHARP_RAMP))


def iou(a: str, b: str) -> Column:
    """Of two box structs x, y, w, h."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(f"{a}.x") + c(f"{a}.w"), c(f"{b}.x") + c(f"{b}.w")) - F.greatest(c(f"{a}.x"), c(f"{b}.x")))
    h = F.greatest(F.lit(0.0), F.least(c(f"{a}.y") + c(f"{a}.h"), c(f"{b}.y") + c(f"{b}.h")) - F.greatest(c(f"{a}.y"), c(f"{b}.y")))
    return w * h / (c(f"{a}.w") * c(f"{a}.h") + c(f"{b}.w") * c(f"{b}.h") - w * h + 1e-6)


def crop_box(box: str, pad: float = 0.2) -> Column:
    """A normalised box with padding on all sides, clamped to the image."""
    x, y, w, h = (F.col(f"{box}.{k}") for k in "xywh")
    left, top = F.greatest(F.lit(0.0), x - w * pad), F.greatest(F.lit(0.0), y - h * pad)
    return F.struct(left.alias("x"), top.alias("y"), (F.least(F.lit(1.0), x + w * (1 + pad)) - left).alias("w"), (F.least(F.lit(1.0), y + h * (1 + pad)) - top).alias("h"))


def similarity_fit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares rotation, scale and shift from points (sx, sy) to (dx, dy) of each key: a, b, tx, ty.

    x' = a x - b y + tx, y' = b x + a y + ty; plain sums, so it runs as one aggregate.
    """
    s = lambda e: F.sum(F.expr(e))
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"), s("sx").alias("x"), s("sy").alias("y"), s("dx").alias("u"), s("dy").alias("v"),
        s("sx*sx + sy*sy").alias("q"), s("sx*dx + sy*dy").alias("p"), s("sx*dy - sy*dx").alias("r"),
    )
    den = F.expr("q - (x*x + y*y)/n")
    a, b = F.expr("p - (x*u + y*v)/n") / den, F.expr("r - (x*v - y*u)/n") / den
    out = sums.withColumn("a", a).withColumn("b", b)
    return out.select(*keys, "a", "b", F.expr("(u - a*x + b*y)/n").alias("tx"), F.expr("(v - b*x - a*y)/n").alias("ty"))


@F.pandas_udf(BinaryType())
def wav_pack(samples: pd.Series) -> pd.Series:
    """Mono 16 kHz 16-bit WAV from float samples, clamped to ±1; all rows of a batch are converted at once."""
    parts = [np.asarray(x if x is not None else [], np.float64) for x in samples]
    data = np.round(np.clip(np.concatenate([np.zeros(0), *parts]), -1, 1) * 32767).astype("<i2").tobytes()
    ends = np.cumsum([0] + [2 * len(x) for x in parts])
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data"
    return pd.Series([b"RIFF" + struct.pack("<I", 36 + b - a) + head + struct.pack("<I", b - a) + data[a:b] for a, b in zip(ends, ends[1:])], dtype=object)


def suppressed(boxes: DataFrame, image: str, threshold: float = 0.4) -> DataFrame:
    """Non-maximum suppression per image over columns x, y, w, h, confidence: the boxes that stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "x", "y"], ascending=[False, True, True], kind="stable")
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        alive, keep = np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            if alive[i]:
                keep.append(i)
                iw = np.maximum(0, np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x))
                ih = np.maximum(0, np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y))
                alive &= iw * ih / (w[i] * h[i] + w * h - iw * ih + 1e-6) <= threshold
        return pdf.iloc[keep]

    return boxes.groupBy(image).applyInPandas(run, boxes.schema)


def ctc_decode(steps: DataFrame, line: str, alphabet: list[str]) -> DataFrame:
    """Greedy decoding of rows (line, step, probs): blank is class 0, repeats collapse; text and mean probability.

    A row that isn't a distribution is taken as logits.
    """
    rows = steps.select(line, "step", F.transform("probs", lambda x: x.cast("double")).alias("p")).withColumn("most", F.array_max("p"))
    is_dist = (F.array_min("p") >= 0) & (F.abs(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-2)
    prob = F.when(is_dist, F.col("most")).otherwise(1 / F.aggregate("p", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most"))))
    rows = rows.select(line, "step", (F.array_position("p", F.col("most")) - 1).cast("int").alias("cls"), prob.alias("prob"))
    before = F.lag("cls").over(Window.partitionBy(line).orderBy("step"))
    taken = F.when((F.col("cls") != 0) & ~F.col("cls").eqNullSafe(F.col("before")), F.struct("step", "cls", "prob"))
    out = rows.withColumn("before", before).groupBy(line).agg(F.array_sort(F.collect_list(taken)).alias("r"))
    table = F.array(*[F.lit(c) for c in alphabet])
    return out.select(
        line,
        F.array_join(F.transform("r", lambda r: F.element_at(table, r["cls"])), "").alias("text"),
        F.coalesce(F.aggregate("r", F.lit(0.0), lambda s, r: s + r["prob"]) / F.nullif(F.size("r"), F.lit(0)), F.lit(0.0)).alias("score"),
    )


def aligned(pixels: np.ndarray, fit: tuple[float, float, float, float], side: int = 112, mirror: bool = False) -> np.ndarray:
    """A square of bilinear samples of an image (height, width, channels), as bytes.

    ``fit`` (a, b, tx, ty, see ``similarity_fit``) maps pixels of the square to points of the image; what lies outside the
    image is 0; ``mirror`` flips the square from left to right.
    """
    a, b, tx, ty = fit
    v, u = np.mgrid[0:side, 0:side].astype(float)
    u = side - 1 - u if mirror else u
    x, y = a * u - b * v + tx, b * u + a * v + ty
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    h, w = pixels.shape[:2]

    def at(dx: int, dy: int) -> np.ndarray:
        i, j = y0 + dy, x0 + dx
        inside = (i >= 0) & (j >= 0) & (i < h) & (j < w)
        share = (x - x0 if dx else 1 - (x - x0)) * (y - y0 if dy else 1 - (y - y0))
        return pixels[np.where(inside, i, 0), np.where(inside, j, 0)] * (share * inside)[..., None]

    return np.floor(sum(at(dx, dy) for dx in (0, 1) for dy in (0, 1)) + 0.5).astype(np.uint8)


def sharpness(grey: Column) -> Column:
    """Sharpness of a grey image given as rows of pixels: ``laplacian_variance`` as a vectorised function."""
    return _sharpness(grey)


@F.pandas_udf(DoubleType())
def _sharpness(images: pd.Series) -> pd.Series:
    return pd.Series([laplacian_variance(np.stack(x)) for x in images], dtype=float)


def box_rows(images: DataFrame, key: str, probability: str) -> DataFrame:
    """(key, x, y, w, h, score) of the text boxes of each probability map, given as rows of probabilities."""

    def run(batches):
        for pdf in batches:
            out = [(k, *b) for k, m in zip(pdf[key], pdf[probability]) for b in text_boxes(np.stack(m).astype(float))]
            yield pd.DataFrame(out, columns=[key, "x", "y", "w", "h", "score"])

    return images.select(key, probability).mapInPandas(run, f"{key} {dict(images.dtypes)[key]}, x double, y double, w double, h double, score double")


def text_boxes(probability: np.ndarray, low: float = 0.3, mean_least: float = 0.6, least: int = 3, unclip: float = 1.5) -> list[tuple[float, float, float, float, float]]:
    """Boxes (x, y, w, h, score) of 4-connected regions of a probability map, grown by area * unclip / perimeter."""
    mask = probability > low
    seen = np.zeros_like(mask)
    out = []
    for y0, x0 in zip(*np.nonzero(mask)):
        if seen[y0, x0]:
            continue
        todo, cells = [(y0, x0)], []
        seen[y0, x0] = True
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not seen[v, u]:
                    seen[v, u] = True
                    todo.append((v, u))
        ys, xs = np.array(cells).T
        w, h = float(np.ptp(xs) + 1), float(np.ptp(ys) + 1)
        score = float(probability[ys, xs].mean())
        if min(w, h) >= least and score >= mean_least:
            grow = w * h * unclip / (2 * (w + h))
            left, top = max(0.0, xs.min() - grow), max(0.0, ys.min() - grow)
            out.append((left, top, min(probability.shape[1], xs.max() + 1 + grow) - left, min(probability.shape[0], ys.max() + 1 + grow) - top, score))
    return sorted(out, key=lambda b: -b[4])


def laplacian_variance(grey: np.ndarray) -> float:
    """Sharpness of the central 20-80 % of a grey image."""
    h, w = grey.shape
    g = grey.astype(float)
    full = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    part = full[max(0, int(h * 0.2) - 1) : int(h * 0.8) - 1, max(0, int(w * 0.2) - 1) : int(w * 0.8) - 1]
    return float((part**2).mean() - part.mean() ** 2)
