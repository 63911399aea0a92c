"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

A token is a run of letters, of digits, or of other signs. Every token has a random index vector drawn from its hash, so
no vocabulary is needed to give one. A word vector is the token's index vector plus those of its neighbours, summed over all
texts of the corpus and scaled to length 1, for every token that makes up at least ``MIN_SHARE`` of all tokens; a rarer one keeps its
index vector. So the list of word vectors, which goes to every task, has 1 / ``MIN_SHARE`` entries at most, whatever the corpus, and
everything that is counted is counted over all of it: tokens in one pass (pre-aggregated in each task), context sums in another. A document is
the mean of its tokens' vectors and that mean's length, and goes through one hidden layer to a logit, which is divided by
a temperature fitted on held-out rows.

Only the network is fitted on a bounded sample of labelled rows: the ``max_fit_docs`` label rows that come first by a hash of
their doc_id, of which the driver gets the pooled vectors and no text. Scoring covers all documents and whole texts, in one pass
without a shuffle.

Edge cases: null and empty texts pool to the zero vector and are scored like any other; label rows with a null in doc_id
or label, or with a doc_id not in the documents, are not used; several labels of one doc_id count as the lowest, several texts of
one doc_id as the one with the least pooled vector; with no usable label row, or with one class only, every probability is 1 and nothing
is rejected. Repeated documents each keep their row. The output column replaces one of its name; other columns pass through.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import runtime, textops

DIM, WINDOW, HIDDEN = 32, 2, 32
MAX_FIT_DOCS, THRESHOLD = 4000, 0.5
MIN_SHARE = 1 / 20_000


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Signs (int8) of the random index vectors, from the tokens' hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, : DIM // 8], axis=1)
    return (bits.astype(np.int8) << 1) - 1


def tokens(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the joined texts and each document's first token."""
    cps, offsets = textops.codepoints(group)
    kind = textops.classes()[cps]
    starts, ends = textops.runs(kind, offsets)
    if len(starts):
        keep = kind[starts] != textops.SPACE
        starts, ends = starts[keep], ends[keep]
    return textops.run_hash(textops.prefix_hash(cps), starts, ends), np.searchsorted(starts, offsets)


@dataclasses.dataclass
class Model:
    """Word vectors (sorted by hash), network and temperature; ``weights`` is None for the constant model."""

    vocab: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] | None = None
    temperature: float = 1.0

    def pool(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM + 1), np.float32)
        for at, group in textops.slices(texts):
            h, first = tokens(group)
            if not len(h):
                continue
            v = index_vectors(h).astype(np.float32) / np.float32(DIM**0.5)
            if len(self.vocab):
                i = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
                known = np.flatnonzero(self.vocab[i] == h)
                v[known] = self.vectors[i[known]]
            n = np.diff(first)
            some = np.flatnonzero(n)
            mean = np.add.reduceat(v, first[some], axis=0) / n[some, None]
            out[at + some, :DIM] = mean
            out[at + some, DIM] = np.sqrt((mean**2).sum(1))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probability(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(texts))
        z = self.logits(self.pool(texts)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def context_sums(group: list[str], vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``vocab``, sums of the index vectors of these tokens and their neighbours) over some texts."""
    h, first = tokens(group)
    at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
    known = np.flatnonzero(vocab[at] == h) if len(vocab) and len(h) else np.zeros(0, np.int64)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.int64)
    v = index_vectors(h)
    doc = np.repeat(np.arange(len(group)), np.diff(first))
    c = v.copy()
    for k in range(1, WINDOW + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        c[k:] += v[:-k] * same
        c[:-k] += v[k:] * same
    order = known[np.argsort(at[known], kind="stable")]
    place = at[order]
    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[begin], np.add.reduceat(c[order], begin, axis=0, dtype=np.int64)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's tokens with their numbers."""
    held, number, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, own = np.unique(np.concatenate([held, *(k for k, _ in waiting)]), return_inverse=True)
        return keys, np.bincount(own, weights=np.concatenate([number, *(n for _, n in waiting)]), minlength=len(keys)).astype(np.int64)

    for batch in runtime.parts(batches):
        for _, group in textops.slices(batch.column(0).to_pylist()):
            waiting.append(np.unique(tokens(group)[0], return_counts=True))
        if sum(len(k) for k, _ in waiting) > 1 << 20:
            held, number = merged()
            waiting = []
            if len(held) > 1 << 21:  # a task of very many tokens gives them in parts
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(number)], names=["token", "n"])
                held, number = held[:0], number[:0]
    held, number = merged()
    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(number)], names=["token", "n"])
    runtime.release()


def word_vectors(docs: DataFrame, min_share: float = MIN_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, vectors of length 1) of the frequent tokens, over all texts."""
    spark, texts = docs.sparkSession, docs.where("text IS NOT NULL").select("text")
    counted = runtime.written(texts.mapInArrow(_token_rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("n") >= min_share * total).select("token").toArrow()
    runtime.drop(counted)
    vocab = np.sort(frequent.column(0).to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(vocab)
    names = ["at", *(f"c{d}" for d in range(DIM))]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        sums = np.zeros((len(vocab), DIM), np.int64)
        for batch in runtime.parts(batches):
            for _, group in textops.slices(batch.column(0).to_pylist()):
                place, c = context_sums(group, vocab)
                sums[place] += c
        met = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(sums[met, d]) for d in range(DIM))], names=names)
        runtime.release()

    parts = texts.mapInArrow(contexts, ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
    sums = np.zeros((len(vocab), DIM), np.float32)
    sums[found.column(0).to_numpy()] = np.column_stack([found.column(n).to_numpy() for n in names[1:]])
    return vocab, sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-6)


def fit(model: Model, x: np.ndarray, labels: np.ndarray, seed: int = 0, epochs: int = 300) -> Model:
    """Fits the network on four fifths of the pooled rows and calibrates on the rest; deterministic in the order of the rows."""
    labels, x = np.asarray(labels, np.float64), np.asarray(x, np.float64)
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    if len(set(labels[train].tolist())) < 2:
        train = order
    model.mean, model.scale = x[train].mean(0), x[train].std(0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    z, y = (x[train] - model.mean) / model.scale, labels[train]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        hidden = np.maximum(z @ p[0] + p[1], 0)
        d = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - y) / len(y)
        back = np.outer(d, p[2]) * (hidden > 0)
        for i, g in enumerate((z.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            p[i] -= 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.weights = tuple(p)
    if len(held):
        logit, y = model.logits(x[held]), labels[held]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit_from(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_docs: int = MAX_FIT_DOCS, seed: int = 0, min_share: float = MIN_SHARE) -> Model:
    """Word vectors of the whole corpus, and a network fitted on at most ``max_fit_docs`` labelled documents."""
    spark = docs.sparkSession
    runtime.small_batches(spark)
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_docs).collect()
    if len({r[1] > 0 for r in picked}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32))
    model = Model(*word_vectors(docs, min_share))
    shared = spark.sparkContext.broadcast(model)
    chosen = spark.createDataFrame([(int(r[0]), float(r[1] > 0)) for r in picked], "doc_id long, _label double")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.parts(batches):
            x = shared.value.pool([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text")
    rows = rows.mapInArrow(pooled, "doc_id long, label double, x array<float>").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return fit(model, np.array([r["x"] for r in found]).reshape(-1, DIM + 1), np.array([r["label"] for r in found]), seed)


def scored(docs: DataFrame, model: Model, output: str = "quality_prob") -> DataFrame:
    """``docs`` with the probability of good quality added as ``output``."""
    docs = docs.drop(output)
    runtime.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.parts(batches):
            p = shared.value.probability([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, output])
        runtime.release()

    return docs.mapInArrow(score, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_fit_docs: int = MAX_FIT_DOCS, output: str = "quality_prob") -> DataFrame:
    """The documents whose calibrated probability of good quality is at least ``threshold``, with that probability."""
    return scored(docs, fit_from(docs, labels, max_fit_docs=max_fit_docs), output).where(F.col(output) >= threshold)
