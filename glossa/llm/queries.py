"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, fingerprint, linededup, mixing, ngramjoin, quality, runtime, suffixdedup, tokenfile, topk, urlfilter


KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "labels": "doc_id"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return runtime.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS[table])


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(_read(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_read(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.classes(_read(spark, sf_dir, "documents"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.stepped_weights(r[0] for r in docs.select("source").distinct().collect()))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(_read(spark, sf_dir, "pages"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 50, asked against all rows."""
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, queries=vectors.where(f"vec_id % {topk.QUERY_EVERY} = 0"))


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.binary_output(_read(spark, sf_dir, "documents"))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(_read(spark, sf_dir, "documents"))


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.quality_filter(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return kept.select("doc_id", "lang", "source", "quality_prob")


QUERIES = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_line_dedup": line_dedup,
    "op3_byte_bpe": byte_bpe,
    "op4_fingerprints": fingerprints,
    "op5_mix_sources": mix_sources,
    "op6_url_filter": url_filter,
    "op7_top_k": exact_top_k,
    "op8_token_output": token_output,
    "op9_ngram_join": ngram_join,
    "op10_quality_filter": quality_filter,
}

ORACLES = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_url_filter": urlfilter.oracle_sql(),
    "op7_top_k": topk.ORACLE_SQL,
    "op9_ngram_join": ngramjoin.ORACLE_SQL,
}
