"""Corpora and matrices from memory and from tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.base import MATRIX


def corpus(spark: SparkSession, *texts: str | None) -> DataFrame:
    """``(doc_id, text)``; a text's place is its id."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def read_corpus(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a Parquet table; no other column is read."""
    return spark.read.parquet(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def matrix(spark: SparkSession, rows: Sequence[Sequence[float]] | np.ndarray) -> DataFrame:
    """The long form of a terms x documents array."""
    a = np.asarray(rows, np.float64)
    return spark.createDataFrame([(int(j), int(i), float(a[i, j])) for i, j in zip(*np.nonzero(a))], MATRIX)


def vectors(spark: SparkSession, rows: Sequence[Sequence[float]] | np.ndarray) -> DataFrame:
    """``(id, vec)``; a row's place is its id."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.asarray(rows, np.float64))], "id bigint, vec array<double>")


def to_numpy(entries: DataFrame, row: str, column: str, shape: tuple[int, int]) -> np.ndarray:
    """A small matrix on the driver, for tests and plots."""
    out = np.zeros(shape)
    for r in entries.select(row, column, entries.columns[-1]).collect():
        out[r[0], r[1]] = r[2]
    return out
