"""Vector expressions over array columns; all stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the inner product; both are taken to have length one."""
    return 1 - dot(a, b)


def comparable_cosine(a: Column, b: Column) -> Column:
    """The similarity of vectors of one length above zero, else null."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return F.transform(a.cast("array<double>"), lambda x: F.coalesce(x / F.nullif(length(a), F.lit(0.0)), x))
