"""Vector algebra on array columns, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def scaled(a: Column | str, factor: Column | float) -> Column:
    return F.transform(col(a), lambda x: x * factor)


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(col(a), lambda x: x * x)))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str, eps: float = EPS) -> Column:
    """Cosine clipped to [-1, 1]; NULL where the product of the norms is at most ``eps``, NaN or infinite."""
    size = norm(a) * norm(b)
    return F.when(finite(size) & (size > eps), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def finite(c: Column | str) -> Column:
    """False for NaN, which Spark takes to be above all numbers, and for infinities; NULL for NULL."""
    return F.abs(col(c)) < F.lit(float("inf"))


def width(table: DataFrame, column: str) -> int:
    """The length of a table's vectors by one of them; 1 for a table without any."""
    row = table.where(F.col(column).isNotNull()).select(column).first()
    return len(row[0]) if row else 1


def mean_vector(column: str, dimensions: int) -> Column:
    """Mean of an array column over a group, dimension by dimension, so that partial sums are combined before a shuffle."""
    return F.array(*[F.avg(F.get(F.col(column), F.lit(i))) for i in range(dimensions)])


def sum_vector(column: str, dimensions: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(dimensions)])


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)
