"""Mixing sources to target weights by capped water-filling.

The budget (all characters of the corpus, or a given number) is shared in proportion to the sources' target weights. A
source whose share exceeds ``max_epochs`` times its size is clamped there, and what it cannot take goes to the others in
proportion to their weights, again and again until no share is above its cap. Share / size is a source's number of epochs:
its whole part repeats every document, and its fraction adds one more copy of the documents whose seeded hash falls below it.

Sizes come from one aggregation over all documents; what reaches the driver is one row a source. The plan of copies goes
back as a join (broadcast behind a check of its size), and repetition is a generator: no text is shuffled.

Edge cases: a null source is a source of its own; a source without a weight (or with a null, zero or negative one) gets
no copies; null texts have size 0, and a source of size 0 gets no copies; repeated rows have equal hashes, so they are
taken together; ties do not arise, for documents are compared with a threshold and not with each other; an empty table
gives an empty table. Other columns pass through, whatever their names; one with the name of the copy's number is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime

MAX_EPOCHS, SEED, STEPS = 4.0, 17, 1 << 32


def water_fill(sizes: dict, weights: dict, budget: float, max_epochs: float = MAX_EPOCHS) -> dict:
    """Share of each source: proportional to weight, at most ``max_epochs`` times its size, in all at most ``budget``."""
    free = {s for s, n in sizes.items() if n > 0 and (weights.get(s) or 0) > 0}
    share = dict.fromkeys(sizes, 0.0)
    left = float(budget)
    while free:
        level = left / sum(weights[s] for s in sorted(free, key=str))
        full = {s for s in free if weights[s] * level > max_epochs * sizes[s]}
        if not full:
            share.update({s: weights[s] * level for s in free})
            break
        share.update({s: max_epochs * sizes[s] for s in full})
        left -= sum(max_epochs * sizes[s] for s in sorted(full, key=str))
        free -= full
    return share


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 2**32) from the seed and a row's key."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("long")


def copies(docs: DataFrame, weights: dict | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """``(_source, _whole, _below)`` for every source: whole repetitions, and the threshold for one more."""
    sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    weights = dict.fromkeys(sizes, 1.0) if weights is None else weights
    share = water_fill(sizes, weights, sum(sizes.values()) if budget is None else budget, max_epochs)
    rows = []
    for source, n in sizes.items():
        # one part in 2**20 is below any use and keeps sums of floats in another order from moving the whole part
        epochs = round(share[source] / n * (1 << 20)) if n else 0
        rows.append((source, epochs >> 20, (epochs & ((1 << 20) - 1)) << 12))
    return docs.sparkSession.createDataFrame(rows, "_source string, _whole long, _below long")


def mix(docs: DataFrame, weights: dict | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: int = SEED, copy_no: str | None = "copy_no") -> DataFrame:
    """The documents, each as often as the mixture asks, numbered from 1 in ``copy_no`` (None: not numbered).

    ``weights``: target weight by source; None weighs all sources alike. ``budget``: characters; None takes the corpus's.
    """
    kept = [c for c in docs.columns if c != copy_no]
    source, whole, below, times, copy = (runtime.fresh(c, docs) for c in ("_source", "_whole", "_below", "_n", "_copy"))
    plan = runtime.small_side(copies(docs, weights, max_epochs, budget).toDF(source, whole, below), 100)
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col(source)))
    n = F.col(whole) + (draw(F.col("doc_id"), seed) < F.col(below)).cast("long")
    out = joined.withColumn(times, n).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return out.select(*kept, *([F.col(copy).alias(copy_no)] if copy_no else []))


def stepped_weights(sources: Iterable[str | None]) -> dict:
    """Target weights of the registered query: 1.5 to the place of the source by name (modulo 20), so that the cap binds again and again."""
    return {s: 1.5 ** (i % 20) for i, s in enumerate(sorted(set(sources), key=lambda s: (s is not None, s or "")))}


# Closed form of the same filling: the sources in order of size / weight; those below the water level are the clamped ones.
ORACLE_SQL = f"""
WITH z AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS n FROM documents GROUP BY source),
p AS (SELECT source, n, {MAX_EPOCHS} * n AS cap, pow(1.5::DOUBLE, (SELECT count(*) FROM z y WHERE y.source < z.source OR y.source IS NULL AND z.source IS NOT NULL) % 20) AS w, (SELECT sum(n) FROM z) AS budget FROM z WHERE n > 0),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM p),
l AS (SELECT max((budget - before) / rest) FILTER (WHERE (budget - before) / rest <= cap / w) AS level FROM o),
e AS (SELECT source, CAST(round(least(cap, w * coalesce(level, cap / w)) / n * 1048576) AS BIGINT) AS parts FROM o, l),
c AS (SELECT d.*, parts // 1048576 + CASE WHEN CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
             < (parts % 1048576) * 4096 THEN 1 ELSE 0 END AS k FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS BIGINT) AS copy_no FROM (SELECT *, unnest(range(1, k + 1)) AS copy_no FROM c)
"""
