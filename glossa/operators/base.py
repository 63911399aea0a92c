"""What all steps share: fit, transform, fit_transform, and the long form of matrices.

A matrix is a table ``(doc_id, term_idx, value)`` of its entries other than zero; a dense result has the same form with
its component in ``term_idx``'s place (``comp``), or one array a document. Vectorisers take ``(doc_id, text)``.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX = "doc_id bigint, term_idx int, value double"


class Step:
    """One step of a pipeline. ``transform`` before ``fit`` raises; ``fit`` returns the step itself.

    ``documents``: while a pipeline fits its steps, the number of the corpus's documents, those without entries among them.
    """

    documents: int | None = None

    def fit(self, df: DataFrame) -> Step:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def fitted(value, what: str):
    if value is None:
        raise ValueError(f"{what} is used before it was fitted")
    return value


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, ``spark.checkpoint.dir``; set here only where it is unset, and then only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="glossa-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table written to the shared folder: a cut in the lineage that no executor's loss undoes."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores is dealt out by ``key``; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def save_json(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    """Raises ValueError if the description is missing or cut short."""
    try:
        return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
    except Exception as e:
        raise ValueError(f"no complete description at {path}") from e


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the table, whose rows have at most ``row_bytes`` bytes, has no more than ``limit`` bytes by count; else the plain table."""
    most = limit // max(1, row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
