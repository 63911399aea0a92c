"""LSH schemes: from signatures (strings of 0 and 1, functions x tables long) to candidates.

Signatures are cut into one key a table. Both schemes take ``(id, bits)`` tables for index and queries and give distinct
``(query_id, id)`` pairs; indexing, searching and removing are operations on immutable tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.base import written


class LSHScheme:
    def __init__(self, functions: int, tables: int) -> None:
        self.functions, self.tables = functions, tables

    def keys(self, bits: Column) -> Column:
        """The keys of a signature, by table; a signature of another length raises an error."""
        f = self.functions
        cut = F.array(*[F.substring(bits, t * f + 1, f) for t in range(self.tables)])
        wrong = F.raise_error(F.lit(f"signatures of {f * self.tables} bits are expected")).cast("array<string>")
        return F.when(bits.isNull() | (F.length(bits) == f * self.tables), cut).otherwise(wrong)

    def put(self, signatures: DataFrame) -> DataFrame:
        """``(table_no, band_key, id)``: the buckets' contents."""
        return signatures.where("bits IS NOT NULL").select("id", F.posexplode(self.keys(F.col("bits"))).alias("table_no", "band_key"))

    @staticmethod
    def remove(buckets: DataFrame, ids: DataFrame) -> DataFrame:
        return buckets.join(ids.select("id"), "id", "left_anti")

    def candidates(self, buckets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError


class ClassicLSH(LSHScheme):
    """Candidates share the query's bucket in at least one table; k plays no part."""

    def candidates(self, buckets: DataFrame, queries: DataFrame, k: int = 0) -> DataFrame:
        asked = self.put(queries).withColumnRenamed("id", "query_id")
        return asked.join(buckets, ["table_no", "band_key"]).select("query_id", "id").distinct()


class LSHForest(LSHScheme):
    """Candidates by the longest prefix of a key that they share with the query in any table: all with a whole key in common,
    then, until there are k, all at the next shorter prefix.

    Prefix lengths are taken from bucket sizes first: at the longest prefix where one table alone has k ids, the union over
    tables has as many, so ids with shorter prefixes cannot be needed and are never joined. Sizes are summed from whole keys (at most
    2 ** functions a table, however many ids there are), and the index's rows are cut only at the lengths that some query needs.
    """

    @staticmethod
    def _prefixes(rows: DataFrame, depths: list[int]) -> DataFrame:
        depth = F.explode(F.array(*map(F.lit, depths))).alias("depth")
        return rows.select("*", depth).withColumn("prefix", F.expr("substring(band_key, 1, depth)"))

    def candidates(self, buckets: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
        at, every = ["table_no", "depth", "prefix"], list(range(self.functions + 1))
        keys = buckets.groupBy("table_no", "band_key").agg(F.count("*").alias("n"))
        sizes = self._prefixes(keys, every).groupBy(*at).agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        asked = self.put(queries).withColumnRenamed("id", "query_id")
        enough = self._prefixes(asked, every).join(sizes, at).groupBy("query_id").agg(F.max("depth").alias("least"))
        # without a table of k ids at any length, the root (all ids) is the last resort
        used = written(asked.join(enough, "query_id", "left").withColumn("depth", F.coalesce("least", F.lit(0))).withColumn("prefix", F.expr("substring(band_key, 1, depth)")), "asked")
        depths = sorted(r[0] for r in used.select("depth").distinct().collect()) or [0]
        shared = used.withColumnRenamed("band_key", "asked_key").join(self._prefixes(buckets, depths), at)
        longest = F.length(F.regexp_extract(F.concat_ws(" ", "asked_key", "band_key"), r"^([01]*)[01]* \1", 1))
        best = shared.groupBy("query_id", "id").agg(F.max(longest).alias("lcp"))
        ranked = best.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("lcp"))))
        return ranked.where((F.col("r") <= k) | (F.col("lcp") == self.functions)).select("query_id", "id")
