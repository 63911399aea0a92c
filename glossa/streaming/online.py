"""Online learning on streams: term counts by hash, and random indexing one micro-batch at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators.randproj import RandomIndexing, random_rows
from glossa.operators.vectorise import HashingVectoriser

CONTEXTS = "term_idx int, comp int, value double"


def context_stream(docs: DataFrame, vectoriser: HashingVectoriser, k: int, density: float, seed: int = 0) -> DataFrame:
    """Running ``(term_idx, comp, value)`` sums of a stream of documents, in units of the projection's scale.

    The hashed vocabulary needs no fitting, and a document's random vector is a hash of its id, so the sums over any
    micro-batches equal those of one batch. Use output mode complete or update.
    """
    counts = vectoriser.transform_rows(docs)
    signed = random_rows(counts, F.col("doc_id"), k, density, seed)
    return signed.groupBy("term_idx", "comp").agg(F.sum(F.col("value") * F.col("sign")).alias("value"))


def fit_online(docs: DataFrame, vectoriser: HashingVectoriser, model: RandomIndexing, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds every micro-batch to the model's term vectors; the caller stops it.

    Each batch's contexts are written beside the checkpoint under the batch's number, and the vectors are the sum of what
    stands there: a batch that is delivered again replaces itself, and a new driver goes on where the last one ended.
    """
    spark, folder = docs.sparkSession, f"{checkpoint.rstrip('/')}-contexts"

    def summed() -> None:
        try:
            held = spark.read.schema(CONTEXTS).parquet(f"{folder}/batch=*")
        except AnalysisException:  # no batch has been written
            return
        model._vectors = held.groupBy("term_idx", "comp").agg(F.sum("value").alias("value"))

    def add(batch: DataFrame, number: int) -> None:
        model.contexts(vectoriser.transform(batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        summed()

    summed()
    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
