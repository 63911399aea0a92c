"""Site-relative line dedup: lines that too large a share of a host's pages contain are boilerplate and go.

For every host, the number of its pages that contain a line (trimmed; once a page) is divided by the host's number of
pages. Lines above ``max_ratio`` that stand on at least ``min_pages`` pages are dropped from all pages of that host.

Only 128-bit line hashes are shuffled, never text, and equal lines are counted where they are read first. The lines to
drop are few: a host has at most (mean lines a page) / max_ratio of them. They become one set a host; that table is
broadcast if its counted size allows and joined by host otherwise.

Edge cases: a null text stays null; lines are split at newlines and compared without surrounding blanks; blank lines
are neither counted nor dropped; null and empty hosts are one host; repeated rows count as separate pages; a page whose
lines all go keeps its row with an empty text; an empty table gives an empty table. Other columns pass through, whatever their names.
``n_chars``, where present, is set to the new length (null for a null text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime

MAX_RATIO, MIN_PAGES = 0.05, 5
BLANKS = " \t\r"


def line_key(line: Column) -> Column:
    """128 bits of a line, as two numbers."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(_host, _drop)``: the set of line keys that go, for each host that has any."""
    at = F.coalesce(F.col(host), F.lit(""))
    full = F.filter(_lines(F.col("text")), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    keys = pages.select(at.alias("_host"), F.explode(F.array_distinct(F.transform(full, line_key))).alias("_key"))
    # A separate scan of the host column alone: the pages without lines count too, and it reads no text.
    totals = pages.groupBy(at.alias("_host")).agg(F.count("*").alias("_pages"))
    counted = keys.groupBy("_host", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    over = counted.join(totals, "_host").where(F.col("_n") > F.lit(max_ratio) * F.col("_pages"))
    return over.groupBy("_host").agg(F.collect_list("_key").alias("_drop"))


def line_dedup(pages: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages without their hosts' boilerplate lines."""
    drop = runtime.written(boilerplate(pages, host, max_ratio, min_pages), "lines")
    at, keys = runtime.fresh("_host", pages), runtime.fresh("_drop", pages)
    total = drop.agg(F.sum(F.size("_drop"))).first()[0] or 0
    side = drop.toDF(at, keys)
    side = F.broadcast(side) if total * 40 <= runtime.BROADCAST_BYTES else side
    keyed = pages.withColumn(at, F.coalesce(F.col(host), F.lit(""))).join(side, at, "left")
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col(keys), line_key(x))), "\n")
    text = F.when(F.col(keys).isNull(), F.col("text")).otherwise(kept)
    out = keyed.withColumn("text", text)
    if "n_chars" in pages.columns:
        out = out.withColumn("n_chars", F.length("text").cast(pages.schema["n_chars"].dataType))
    return out.select(*pages.columns)


ORACLE_SQL = rf"""
WITH d AS (SELECT *, coalesce(source, '') AS h FROM documents),
l AS (SELECT doc_id, h, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT DISTINCT doc_id, h, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
n AS (SELECT h, k, count(*) AS n FROM k GROUP BY h, k),
t AS (SELECT h, count(*) AS t FROM d GROUP BY h),
b AS (SELECT h, k FROM n JOIN t USING (h) WHERE n >= {MIN_PAGES} AND n > CAST({MAX_RATIO} AS DOUBLE) * t),
s AS (SELECT h, list(k) AS ks FROM b GROUP BY h),
o AS (SELECT doc_id, lang, source, CASE WHEN ks IS NULL THEN text ELSE array_to_string(
        list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ks, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) END AS text
      FROM d LEFT JOIN s USING (h))
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM o
"""
