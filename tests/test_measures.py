import math

import pytest
from pyspark.sql import functions as F

from glossa.functions import measures as m

A, B, Z = [1.0, 2.0, -3.0], [2.0, 2.0, 1.0], [0.0, 0.0, 0.0]


def value(spark, f, a, b, kind="array<double>"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(f(F.col("a"), F.col("b"))).first()[0]


def test_values(spark):
    cos = 3 / (math.sqrt(14) * 3)
    for f, want in {
        m.cosine_similarity: cos, m.cosine_distance: 1 - cos, m.angular_distance: math.acos(cos) / math.pi, m.angular_similarity: 1 - math.acos(cos) / math.pi,
        m.hamming_distance: 2 / 3, m.hamming_similarity: 1 / 3, m.euclidean_distance: math.sqrt(17), m.manhattan_distance: 5, m.vector_len_similarity: math.sqrt(3),
    }.items():
        assert value(spark, f, A, B) == pytest.approx(want, abs=1e-12), f.__name__


def test_undefined_is_nan(spark):
    for f in (m.cosine_similarity, m.cosine_distance, m.angular_distance, m.angular_similarity, m.vector_len_similarity):
        assert math.isnan(value(spark, f, A, Z)), f.__name__
    assert math.isnan(value(spark, m.vector_len_similarity, [1.0], [-1.0]))
    assert value(spark, m.angular_distance, [0.1, 0.3], [0.1, 0.3]) == pytest.approx(0, abs=1e-7)


def test_unequal_lengths_raise(spark):
    for f in (m.cosine_similarity, m.euclidean_distance, m.manhattan_distance, m.hamming_distance):
        with pytest.raises(Exception, match="unequal"):
            value(spark, f, A, [1.0])


def test_packed_bits(spark):
    f = lambda a, b: m.packed_hamming_distance(a, b, 128)
    assert value(spark, f, [-1, 5], [0, 6], "array<bigint>") == (64 + 2) / 128
