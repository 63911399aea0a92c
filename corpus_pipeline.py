"""The corpus pipeline: documents to token ids, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the session's shared
folder and reads again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, linededup, mixing, ngramjoin, quality, runtime


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as the zero vector; rows with a null doc_id are scored like others; repeated rows keep a row each; very
    long texts are scored whole; ties do not arise; an empty table, or labels of one class only, rejects nothing; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = runtime.fresh("_quality_prob", docs)
    return quality.quality_filter(docs, labels, output=name).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go.

    A null text stays null, a document whose lines all go stays with an empty text; a null source is the source without a name;
    repeated rows count as separate pages; very long texts are split whole; a line at the very ratio stays; an empty table
    stays empty; other columns pass through, and ``n_chars`` becomes the new length.
    """
    return linededup.line_dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, stays of each group that the n-gram join connects.

    Null and empty texts and rows with a null doc_id stay; repeated rows of one doc_id stay or go together; a doc_id with several texts
    goes only if each is in the group of a smaller doc_id; very long texts are compared whole; ties go to the least doc_id; an
    empty table stays empty; other columns pass through.
    """
    return ngramjoin.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares of characters; a repeated document is a repeated row.

    A null source is a source of its own; null and empty texts have size 0, and a source of such texts alone gets no copies; repeated
    rows are taken together; ties do not arise; an empty table stays empty; other columns pass through.
    """
    return mixing.mix(docs, copy_no=None)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether they decode to the text again.

    Null and empty texts have no tokens; rows with a null doc_id and repeated rows keep a row each; very long texts are encoded whole; ties
    do not arise; an empty table stays empty; of the documents' columns doc_id, lang and source are kept, others are not read.
    """
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mix_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifier is a fitted network, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES:
        docs = runtime.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
