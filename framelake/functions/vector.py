"""Vector expressions over array<float> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter of the two lengths, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_to_cosine(distance: Column) -> Column:
    """For unit vectors."""
    return 1 - distance * distance / 2


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<float>")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
