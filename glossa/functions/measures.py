"""Similarity and distance of two array columns, as Column expressions.

Vectors of unequal length raise an error. A measure that is not defined for its vectors is NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
Measure = Callable[[Column, Column], Column]


def _zip(a: Column, b: Column, f: Measure) -> Column:
    wrong = F.raise_error(F.lit("vectors of unequal length"))
    return F.zip_with(F.when(F.size(a) != F.size(b), wrong).otherwise(a), b, f)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x.cast("double") * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, NAN).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def angular_distance(a: Column, b: Column) -> Column:
    """Angle in half turns. Rounding above 1 is cut; NaN comes first, for Spark takes it as the greatest number."""
    c = cosine_similarity(a, b)
    return F.when(F.isnan(c), NAN).otherwise(F.acos(F.least(c, F.lit(1.0))) / F.pi())


def angular_similarity(a: Column, b: Column) -> Column:
    return 1 - angular_distance(a, b)


def hamming_distance(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    return F.when(F.size(a) == 0, NAN).otherwise(_sum(_zip(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming_distance(a, b)


def packed_hamming_distance(a: Column, b: Column, bits: int) -> Column:
    """The same for ``bits`` bits packed in arrays of 64-bit words."""
    return _sum(_zip(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double"))) / bits


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x.cast("double") - y)))


manhatten_distance = manhattan_distance


def vector_len_similarity(a: Column, b: Column) -> Column:
    """Square root of the inner product; NaN unless that is positive."""
    d = dot(a, b)
    return F.when(d > 0, F.sqrt(d)).otherwise(NAN)


class Rounded:
    """A measure rounded to some digits: distances that differ by less are ties."""

    def __init__(self, measure: Measure, digits: int) -> None:
        self.measure, self.digits = measure, digits

    def __call__(self, a: Column, b: Column) -> Column:
        return self.of(self.measure(a, b))

    def of(self, value: Column) -> Column:
        return F.round(value, self.digits)
