"""Connected components on written tables, by alternating large-star and small-star steps.

Every step is two joins by node, so no component is gathered in a task; an edge table grows by no step. A node that a third of all
edges meet is one key of a join and of partial minima: the join's skew is left to adaptive execution.

Edge cases: an empty table gives an empty result; repeated edges count once; edges must not be loops; nodes are not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime


def components(edges: DataFrame) -> DataFrame:
    """``(rep, root)`` for every node of an edge: the least node of its connected component."""
    edges = runtime.written(edges, "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = edges, runtime.written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        runtime.drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("b", "a") % (1 << 40)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("rep"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("rep"), F.col("b").alias("root")).union(roots)
        before = now
