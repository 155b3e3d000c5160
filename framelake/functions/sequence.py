"""Order-dependent steps as window expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import normalise_query


def forward_filled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A missing value takes the last one before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def lags(rows: DataFrame, key: str, order: str, expected_ms: float) -> DataFrame:
    """How many milliseconds later than expected each tick came."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order, "id"))
    late = F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return rows.withColumn("lag_ms", F.greatest(F.lit(0.0), late / 1000.0 - expected_ms))


def stalled(rows: DataFrame, key: str, order: str, done: str, checks: int = 20) -> DataFrame:
    """Whether so many checks in a row before this one found the same number of finished tasks; a change starts anew."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = (~F.col(done).eqNullSafe(F.lag(done).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    spell = rows.withColumn("_fresh", fresh).withColumn("_spell", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    n = F.row_number().over(Window.partitionBy(key, "_spell").orderBy(order))
    return spell.withColumn("stalled", n > checks).drop("_spell")


def collapsed_history(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Recent searches: white space normalised, empty ones left out.

    A search that the next one extends, or cuts short, is dropped; of equal searches the latest stays.
    """
    clean = rows.withColumn(text, normalise_query(F.col(text))).where(F.length(text) > 0)
    after = F.lead(text).over(Window.partitionBy(key).orderBy(order))
    same = F.col("_after").startswith(F.col(text)) | F.col(text).startswith(F.col("_after"))
    kept = clean.withColumn("_after", after).where(F.col("_after").isNull() | ~same).drop("_after")
    latest = F.row_number().over(Window.partitionBy(key, text).orderBy(F.desc(order)))
    return kept.withColumn("_n", latest).where("_n = 1").drop("_n")


def lines_text(boxes: DataFrame, image: str, least: float = 0.5, band: float = 10.0) -> DataFrame:
    """Recognised lines (image, x, y, w, h, text, score) as one text: good lines in reading order, joined by line breaks.

    Lines whose centres are within a band of the line that began it are one row, left to right. Lines that share a row and x
    go by centre, y and text, whatever order they arrive in.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf[(pdf.score >= least) & (pdf.text.fillna("").str.strip() != "")].copy()
        good["centre"] = good.y + good.h / 2
        good = good.sort_values(["centre", "x", "y", "text"], kind="stable")
        row, start, number = [], None, -1
        for c in good.centre:
            if start is None or c - start >= band:
                start, number = c, number + 1
            row.append(number)
        good["row"] = np.array(row, int) if row else np.zeros(0, int)
        good = good.sort_values(["row", "x"], kind="stable")
        return pd.DataFrame({image: [pdf[image].iloc[0]], "text": ["\n".join(good.text.str.strip())], "lines": [len(good)]})

    return boxes.groupBy(image).applyInPandas(run, f"{image} {dict(boxes.dtypes)[image]}, text string, lines long")


def yaw(left_x: Column, right_x: Column, nose_x: Column, left_y: Column, right_y: Column, nose_y: Column) -> Column:
    """Offset of the nose from the middle of the eyes along their line, as a share of their distance; 0 for eyes in one place."""
    dx, dy = right_x - left_x, right_y - left_y
    square = dx * dx + dy * dy
    along = (nose_x - (left_x + right_x) / 2) * dx + (nose_y - (left_y + right_y) / 2) * dy
    return F.when(square > 0, F.abs(along / square)).otherwise(0.0)


def decoded_box(anchor_x: Column, anchor_y: Column, offsets: Column, stride: Column, scale: Column, width: Column, height: Column) -> Column:
    """A detector's distances (left, top, right, bottom) from an anchor as a normalised box within the image."""
    edge = lambda i, a, sign: (a + sign * F.get(offsets, F.lit(i)) * stride) / scale
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x1, y1 = clamp(edge(0, anchor_x, -1) / width), clamp(edge(1, anchor_y, -1) / height)
    x2, y2 = clamp(edge(2, anchor_x, 1) / width), clamp(edge(3, anchor_y, 1) / height)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def turned(upright: Column, flipped: Column, least: float = 0.9) -> Column:
    """Whether a line's image is upside down: softmax of two logits."""
    return 1 / (1 + F.exp(upright - flipped)) > least
