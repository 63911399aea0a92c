"""Exact top-k inner-product search of a set of queries (all rows, if none is given) over norm-bucketed vectors.

Vectors are grouped by length into buckets in falling order: a range partitioning by norm, cut where a bucket is full or the
norm has fallen below ``SPREAD`` of its first. A block of queries goes through the buckets from the longest. With theta a query's k-th
best product so far, its local threshold in a bucket is theta / (query's norm * bucket's largest norm), the least cosine that
still counts. Above 1, the bucket is passed over (unread if that holds for the whole block of queries). Otherwise the query prunes by

* coordinates, if its local threshold is high enough that few of the bucket's vectors have a feasible value at its largest
  coordinate (looked up in that coordinate's sorted list), or
* length: only the vectors with norm >= theta / query's norm, a prefix of the bucket,

and the products of what is left are computed in double precision and verified against theta. All bounds have a margin for
rounding and keep equality, so the result is exact.

The buckets are written once to the session's shared folder, the queries in blocks beside them; a task holds one block of queries and
one bucket at a time, whatever the number of vectors. Nothing is broadcast but the list of buckets (one entry for 2,048 vectors). No
shuffle follows. Every bucket that a block of queries cannot pass over is read by it: the work is queries times vectors, less what is pruned.

Edge cases: vectors that are null, empty or hold a null or a value that is not finite neither ask nor are found, like rows with a null id; vectors meet only those
of their own dimension; a row is no partner of rows with its id, and repeated rows of one id are found once (their best product),
while each asks; products are compared rounded to 6 digits, ties go to the least id; with fewer than k partners all are given; zero
vectors have product 0 with all; k below 1 and empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime

K, BLOCK, SPREAD, FEW = 10, 2048, 0.9, 0.05
MARGIN, DIGITS = 2e-6, 6
BUCKET = "dim int, top double, ids binary, vectors binary"


def _bucket_rows(batches: Iterator[pa.RecordBatch], block_size: int) -> Iterator[pa.RecordBatch]:
    """Packs rows (id, dim, norm, vector), sorted by dim and falling norm, into buckets."""
    ids, rows, dim, top = [], [], None, 0.0

    def bucket() -> pa.RecordBatch:
        block = np.array(rows, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([top]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([block.tobytes()])], names=["dim", "top", "ids", "vectors"])

    for batch in batches:
        for i, d, n, v in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (d != dim or len(ids) >= block_size or (n < SPREAD * top and len(ids) >= block_size // 8)):
                yield bucket()
                ids, rows = [], []
            if not ids:
                dim, top = d, n
            ids.append(i)
            rows.append(v)
    if ids:
        yield bucket()


class Bucket:
    """Vectors in falling order of norm, with the sorted coordinate lists that were asked for."""

    def __init__(self, dim: int, top: float, ids: bytes, vectors: bytes) -> None:
        self.top, self.ids = top, np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.spare = len(self.ids) - len(np.unique(self.ids))
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, values) of coordinate f of the unit vectors."""
        if f not in self._lists:
            order = np.argsort(self.unit[:, f])
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]


class Search:
    """The k best partners of a block of queries, over buckets given one after the other."""

    def __init__(self, queries: Bucket, k: int) -> None:
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.theta = np.full(n, -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.focus = np.abs(queries.unit).argmax(1) if n else np.zeros(0, np.int64)
        self.verified = self.by_coordinates = 0

    def needs(self, top: float) -> np.ndarray:
        """The queries that a bucket of this largest norm may still have partners for."""
        return np.flatnonzero(self.q.norms * top >= self.theta - MARGIN)

    def visit(self, b: Bucket) -> None:
        alive = self.needs(b.top)
        if not len(alive):
            return
        scale = self.q.norms[alive] * b.top
        local = np.where(scale > 0, (self.theta[alive] - MARGIN) / np.where(scale > 0, scale, 1), -1)
        few = np.zeros(len(alive), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # The cosine with vectors of the bucket bounds how far their unit vectors may be from the query's at one coordinate.
        high = np.flatnonzero(local > 0.5)
        for f in np.unique(self.focus[alive[high]]):
            mine = high[self.focus[alive[high]] == f]
            x, t = self.q.unit[alive[mine], f], np.minimum(local[mine], 1)
            # a longer product may come with a larger cosine, so the far side is bounded by the larger of both ends
            width = np.sqrt((1 - t * t) * np.maximum(1 - x * x, 0)) + 1e-9
            order, values = b.coordinate(int(f))
            sure = t <= np.abs(x)  # above the query's own coordinate, its value itself is the end of the range
            low = np.where(sure & (x < 0), -1, x * t - width)
            far = np.where(sure & (x > 0), 1, x * t + width)
            first, last = np.searchsorted(values, low), np.searchsorted(values, far, side="right")
            some = last - first <= FEW * len(b.ids)
            few[mine[some]] = True
            size = (last - first)[some]
            if size.sum():
                rows = np.repeat(alive[mine[some]], size)
                at = order[np.arange(size.sum()) + np.repeat(first[some] - (np.cumsum(size) - size), size)]
                product = np.einsum("ij,ij->i", self.q.vectors[rows], b.vectors[at])
                self.by_coordinates += len(rows)
                keep = product >= self.theta[rows] - MARGIN
                found.append((rows[keep], b.ids[at[keep]], product[keep]))
        rest = alive[~few]
        if len(rest):
            norms = self.q.norms[rest]
            least = np.where(norms > 0, (self.theta[rest] - MARGIN) / np.where(norms > 0, norms, 1), -np.inf)
            prefix = np.searchsorted(-b.norms, -(least.min() - MARGIN), side="right")
            product = self.q.vectors[rest] @ b.vectors[:prefix].T
            self.verified += product.size
            bound = self.theta[rest] - MARGIN
            # in a first bucket, what its own k best exclude; ids that repeat and the query itself leave k others
            spare = self.k + b.spare + self.q.spare + 1
            fresh = np.flatnonzero(np.isneginf(bound))
            if len(fresh) and prefix > spare:
                bound[fresh] = np.partition(product[fresh], prefix - spare, axis=1)[:, prefix - spare] - MARGIN
            r, c = np.nonzero(product >= bound[:, None])
            found.append((rest[r], b.ids[c], product[r, c]))
        if found:
            self._merge(*(np.concatenate(x) for x in zip(*found)))

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != self.q.ids[row]
        row, ids = np.append(self.row, row[other]), np.append(self.id, ids[other])
        score = np.append(self.score, np.round(score[other], DIGITS) + 0.0)
        sort = np.lexsort((-score, ids, row))
        row, ids, score = row[sort], ids[sort], score[sort]
        once = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[: len(row)]
        row, ids, score = row[once], ids[once], score[once]
        sort = np.lexsort((ids, -score, row))
        row, ids, score = row[sort], ids[sort], score[sort]
        begin = np.searchsorted(row, np.arange(len(self.q.ids)))
        rank = np.arange(len(row)) - begin[row]
        keep = rank < self.k
        last = rank == self.k - 1
        self.theta[row[last]] = score[last]
        self.row, self.id, self.score, self.rank = row[keep], ids[keep], score[keep], rank[keep] + 1


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _search_rows(folder: str, files: list[tuple[str, list[tuple[int, float]]]], k: int):
    names = ["vec_id", "rank", "neighbor_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for dim, top, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                search = Search(Bucket(dim, top, ids, vectors), k)
                for name, buckets in files:
                    if not any(d == dim and len(search.needs(t)) for d, t in buckets):
                        continue
                    with system.open_input_file(f"{root}/{name}") as f:
                        table = pq.read_table(f, columns=["dim", "top", "ids", "vectors"])
                    for row in table.to_batches(max_chunksize=1):
                        d, t, i, v = (c[0].as_py() for c in row.columns)
                        if d == dim:
                            search.visit(Bucket(d, t, i, v))
                if len(search.row):
                    yield pa.RecordBatch.from_arrays([pa.array(search.q.ids[search.row]), pa.array(search.rank.astype(np.int32)), pa.array(search.id), pa.array(search.score)], names=names)

    return run


def _packed(vectors: DataFrame, id_column: str, column: str, block_size: int, what: str) -> tuple[str, DataFrame]:
    """(folder, buckets) of the vectors that can be compared, written."""
    spark, v = vectors.sparkSession, F.col("v")
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    plain = plain.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ready = plain.select("id", F.size(v).alias("dim"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), "v")
    sort = [F.col("dim"), F.col("norm").desc(), F.col("id")]
    path = runtime.new_path(spark, what)
    ordered = ready.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered.mapInArrow(lambda batches: _bucket_rows(batches, block_size), BUCKET).write.parquet(path)
    return path, spark.read.schema(BUCKET).parquet(path)


def top_k(vectors: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """``(vec_id, rank, neighbor_id, score)``: for every query (a row of ``vectors``, or of ``queries``) its k partners of the largest inner product."""
    spark = vectors.sparkSession
    path, buckets = _packed(vectors, id_column, column, BLOCK, "buckets")
    rows = buckets.select(F.col("_metadata.file_name").alias("file"), "dim", "top").collect() if k > 0 else []
    by_file: dict[str, list[tuple[int, float]]] = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append((r["dim"], r["top"]))
    files = sorted(by_file.items(), key=lambda f: -max(t for _, t in f[1]))
    asked, blocks = buckets, len(rows)
    if queries is not None and k > 0:
        # blocks as large as leaves every core a few: a block reads what it needs of all buckets, so large ones read less
        block_size = max(64, min(BLOCK, queries.count() // (2 * spark.sparkContext.defaultParallelism) + 1))
        _, asked = _packed(queries, id_column, column, block_size, "queries")
        blocks = asked.count()
    return asked.repartition(max(1, blocks)).mapInArrow(_search_rows(path, files, k), "vec_id long, rank int, neighbor_id long, score double")


#: Searches ask with every row whose id this divides, against all rows.
QUERY_EVERY = 50

ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), {DIGITS}) + 0.0 AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM r WHERE rank <= {K}
"""
