"""Vectorisers: texts to term counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.murmur import murmur3, murmur3_udf
from glossa.functions.tokenise import Tokeniser
from glossa.operators.base import Step, fitted, small, written


def indexed(terms: DataFrame, order: str, name: str = "term_idx") -> DataFrame:
    """``terms`` numbered from 0 in the order of a sortable column that is unique.

    The terms are written first, for a partitioning by ranges reads its input twice. The table is sorted by ranges; each partition's rows are numbered by their place in it and the count of rows before
    that partition, so no task sees all rows. Only the counts of the partitions reach the driver.
    """
    placed = written(terms, "terms").repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "terms")
    before, total = [], 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        before.append((r[0], total))
        total += r[1]
    starts = terms.sparkSession.createDataFrame(before, "_part int, _before bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_part", "_at", "_before")


TOKENS = 1 << 20


def once(df: DataFrame) -> bool:
    """Whether each document is one row with a bigint as id, so that its terms can be counted where it stands."""
    if not isinstance(df.schema["doc_id"].dataType, T.LongType):
        return False
    return df.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0


def token_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(ids in order, each token's document by that order, its place, its code, the terms by code), of about ``TOKENS`` tokens of (doc_id, tokens) at a time."""
    held, n = [], 0

    def grouped() -> tuple:
        ids = np.concatenate([b.column(0).to_numpy() for b in held])
        lists = pa.concat_arrays([b.column(1) for b in held])
        sizes = np.diff(lists.offsets.to_numpy())
        found, rank = lists.flatten().dictionary_encode(), np.empty(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        rank[order] = np.arange(len(ids))
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return ids[order], np.repeat(rank, sizes), place, found.indices.to_numpy().astype(np.int64), found.dictionary

    for batch in batches:
        start, at = batch.column(1).offsets.to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(start, start[at] + TOKENS - n, side="right")) - 1)
            held.append(batch.slice(at, end - at))
            n, at = n + int(start[end] - start[at]), end
            if n >= TOKENS or at < batch.num_rows:
                yield grouped()
                held, n = [], 0
    if held:
        yield grouped()


def postings(tokens: DataFrame) -> DataFrame:
    """``(term, docs, counts, doc_id, pos)`` from ``(doc_id, tokens)``: each term of a group of documents once, with its first place. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, place, code, terms in token_groups(batches):
            cell, first, count = np.unique(code * len(ids) + doc, return_index=True, return_counts=True)
            term, docs, pos = cell // len(ids), ids[cell % len(ids)], place[first]
            at = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(cell)) if len(cell) else np.zeros(1, np.int64)
            for i in range(0, len(at) - 1, 4096):
                cut = at[i : i + 4097]
                some, begin = slice(cut[0], cut[-1]), pa.array((cut - cut[0]).astype(np.int32))
                arrays = [terms.take(pa.array(term[cut[:-1]])), pa.ListArray.from_arrays(begin, pa.array(docs[some])), pa.ListArray.from_arrays(begin, pa.array(count[some].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(docs[cut[:-1]]), pa.array(pos[cut[:-1]].astype(np.int32))], names=["term", "docs", "counts", "doc_id", "pos"])

    return tokens.mapInArrow(run, "term string, docs array<bigint>, counts array<int>, doc_id bigint, pos int")


class CountVectoriser(Step):
    """Counts of the terms met at ``fit``, which are numbered by first occurrence: by doc_id, then place in the text.

    Terms are counted where the document stands, and only packed rows (a term of a group of documents) meet the vocabulary. Other terms are dropped at ``transform``. Documents without terms have no rows in the long form; a ``Pipeline`` counts them.
    Fitting again replaces the vocabulary.
    """

    def __init__(self, *stop_words: str, tokeniser: Tokeniser | None = None) -> None:
        self.tokeniser = tokeniser or Tokeniser(stop_words)
        self.vocabulary: DataFrame | None = None

    def _number(self, first: DataFrame) -> None:
        self.vocabulary = written(indexed(first, "first").select("term", "term_idx"), "vocabulary")

    def fit(self, df: DataFrame) -> CountVectoriser:
        tokens = self._postings(df) if once(df) else self.tokeniser.for_each_in(df)
        self._number(tokens.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
        return self

    def _looked_up(self, counts: DataFrame) -> DataFrame:
        vocabulary = fitted(self.vocabulary, "the vectoriser")
        longest = vocabulary.agg(F.max(F.octet_length("term"))).first()[0] or 0
        known = counts.join(small(vocabulary, longest + 40), "term")
        if "docs" in counts.columns:
            known = known.select("term_idx", F.explode(F.arrays_zip("docs", "counts")).alias("e")).select(F.col("e.docs").alias("doc_id"), "term_idx", F.col("e.counts").cast("double").alias("value"))
        return known.select("doc_id", "term_idx", "value")

    def _postings(self, df: DataFrame) -> DataFrame:
        return postings(df.select(F.col("doc_id").cast("long").alias("doc_id"), self.tokeniser.tokenise(F.col("text")).alias("tokens")))

    def transform(self, df: DataFrame) -> DataFrame:
        # Counting first: the join then sees each term once, of a group of documents or of one whose id repeats.
        fitted(self.vocabulary, "the vectoriser")
        if once(df):
            return self._looked_up(self._postings(df))
        return self._looked_up(self.tokeniser.for_each_in(df).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("value")))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Texts are cut once: the written counts, with each term's first place, give the vocabulary too."""
        if once(df):
            counts = written(self._postings(df), "counts")
            self._number(counts.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
            return self._looked_up(counts)
        counts = self.tokeniser.for_each_in(df).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("value"), F.min("pos").alias("pos"))
        counts = written(counts, "counts")
        self._number(counts.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
        return self._looked_up(counts)


class HashingVectoriser(Step):
    """Counts by hashed term: row = MurmurHash3 modulo ``num_features``; colliding terms add up.

    Stateless, so it can run on a stream. The hash is taken of each document's distinct terms, in Arrow batches.
    """

    def __init__(self, num_features: int, *stop_words: str, tokeniser: Tokeniser | None = None) -> None:
        self.num_features, self.tokeniser = num_features, tokeniser or Tokeniser(stop_words)

    def partial_fit(self, df: DataFrame) -> HashingVectoriser:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not df.isStreaming and once(df):
            return self._in_place(df)
        counts = self.tokeniser.for_each_in(df).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
        hashed = counts.select("doc_id", (murmur3_udf("term") % self.num_features).cast("int").alias("term_idx"), "n")
        return hashed.groupBy("doc_id", "term_idx").agg(F.sum("n").cast("double").alias("value"))

    def _in_place(self, df: DataFrame) -> DataFrame:
        n = self.num_features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, doc, _, code, terms in token_groups(batches):
                row = np.asarray(murmur3([t.encode() for t in terms.to_pylist()]), np.int64) % n if len(terms) else np.zeros(0, np.int64)
                cell, count = np.unique(doc * n + row[code], return_counts=True)
                for i in range(0, len(cell), 1 << 16):
                    some = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cell[some] // n]), pa.array((cell[some] % n).astype(np.int32)), pa.array(count[some].astype(np.float64))], names=["doc_id", "term_idx", "value"])

        tokens = df.select(F.col("doc_id").cast("long").alias("doc_id"), self.tokeniser.tokenise(F.col("text")).alias("tokens"))
        return tokens.mapInArrow(run, "doc_id bigint, term_idx int, value double")

    def transform_rows(self, df: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
        """``keep`` columns, ``term_idx`` and ``value`` without a shuffle, for streams: each text is counted where it stands."""
        n, schema = self.num_features, T.StructType([*(df.schema[c] for c in keep), T.StructField("term_idx", T.IntegerType()), T.StructField("value", T.DoubleType())])
        tokens = df.select(*keep, self.tokeniser.tokenise(F.col("text")).alias("_tokens"))

        def run(batches):
            import pandas as pd

            for pdf in batches:
                flat = pdf.explode("_tokens").dropna(subset=["_tokens"])
                if len(flat):
                    terms = pd.unique(flat["_tokens"])
                    row = dict(zip(terms, (murmur3([t.encode() for t in terms]) % n).astype("int32")))
                    flat["term_idx"] = flat["_tokens"].map(row).astype("int32")
                    yield flat.groupby([*keep, "term_idx"], dropna=False).size().astype("float64").rename("value").reset_index()

        return tokens.mapInPandas(run, schema)
