"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a chunk wherever it is one below a multiple of the block size, so chunks depend on
their content and not on where it stands. A signature has one base-64 sign for each chunk's hash. The block size is the
smallest 3 * 2**i that cuts the text into at most 64 chunks on average, halved while there are fewer than 32; a fingerprint
``block:signature:signature2`` carries the signatures at the block size and at twice it (64 and 32 signs at most; the
last sign then stands for all the rest).

Two fingerprints compare where a block size is common to them: 100 * (1 - edit distance / longer length), rounded down, the
best of the common sizes; runs of one sign count three at most, and signatures without a common 7-gram score 0.
``classes`` gives every document's class and number of links, ``links`` the links between fingerprints. Equal fingerprints are one,
equal signatures of unlike fingerprints are one in the comparison; candidates share a 7-gram at the same block
size, and the edit distance of each candidate pair of signatures is computed once a common run, by bit vectors over many pairs at a
time. No candidate is capped; a 7-gram that n signatures share is cut into groups for many tasks. Copies are not expanded into pairs;
links between unlike fingerprints are rows in between, for each counts once whichever block sizes show it.

Rolling and chunk hashes are numpy passes over whole texts in one mapInArrow without a shuffle; only fingerprints and
7-gram hashes are shuffled for the comparison.

Edge cases: a null text has a null fingerprint, no link and a class of its own; an empty text has ``3::`` and is linked only with
equal ones; very long texts are hashed whole; equal rows are one document, rows of one doc_id with unlike fingerprints
are documents of their own and may be linked; rows with a null doc_id are left out by ``classes``; ties do not arise, for all links
count; an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import runtime, textops
from glossa.llm.graph import components

WINDOW, LONG, LEAST_BLOCK = 7, 64, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
GRAM = 7
GROUP, PAIRS = 2048, 1 << 18
LEAST_SCORE = 50


def rolling(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, of it and the six before it."""
    b = data.astype(np.uint32)
    total, weighted, shifted = b.copy(), b * np.uint32(WINDOW), b.copy()
    for j in range(1, WINDOW):
        total[j:] += b[:-j]
        weighted[j:] += b[:-j] * np.uint32(WINDOW - j)
        shifted[j:] ^= b[:-j] << np.uint32(5 * j)
    return total + weighted + shifted


def _signature(ends: np.ndarray, begin: int, end: int, prefix: np.ndarray, most: int) -> str:
    """Signs of the chunks of [begin, end) that stop after the positions ``ends``."""
    cuts = ends[: most - 1]
    starts = np.append(begin, cuts)
    stops = np.append(cuts, end)
    if starts[-1] == end:
        starts, stops = starts[:-1], stops[:-1]
    if not len(starts):
        return ""
    return ALPHABET[(textops.run_hash(prefix, starts, stops) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[str | None]) -> list[str | None]:
    out: list[str | None] = []
    for _, group in textops.slices(texts):
        encoded = [t.encode("utf-8", "surrogatepass") for t in group]
        # zeros between the documents keep the windows apart
        joined = np.frombuffer((b"\0" * (WINDOW - 1)).join([*encoded, b""]), np.uint8)
        roll, prefix, begin = rolling(joined), textops.prefix_hash(joined), 0
        for data in encoded:
            end = begin + len(data)
            own = roll[begin:end]
            block = LEAST_BLOCK
            while block * LONG < len(data):
                block *= 2
            while True:
                ends = begin + 1 + np.flatnonzero(own % np.uint32(block) == block - 1)
                if block == LEAST_BLOCK or len(ends) >= LONG // 2:
                    break
                block //= 2
            at = ends[roll[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
            out.append(f"{block}:{_signature(ends, begin, end, prefix, LONG)}:{_signature(at, begin, end, prefix, LONG // 2)}")
            begin = end + WINDOW - 1
    return [None if t is None else f for t, f in zip(texts, out)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def signatures(column: Column) -> Column:
    """The comparable signatures of a fingerprint: two of (block, sign), runs shortened to three."""
    parts = F.split(column, ":")
    short = lambda i: F.regexp_replace(parts[i], r"(.)\1{3,}", "$1$1$1")
    block = parts[0].cast("long")
    return F.array(F.struct(block.alias("block"), short(1).alias("sign")), F.struct((block * 2).alias("block"), short(2).alias("sign")))


def _grams(sign: Column) -> Column:
    n = F.greatest(F.length(sign) - GRAM + 1, F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(sign, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def similarity(x: Column, y: Column) -> Column:
    """100 less the edit distance in hundredths of the longer signature."""
    longer = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.floor(100 - 100 * F.levenshtein(x, y) / longer).cast("int")


def score(a: Column, b: Column) -> Column:
    """Similarity of two ``signatures`` columns, 0 to 100."""
    best = []
    for i in (0, 1):
        for j in (0, 1):
            x, y = a[i], b[j]
            common = (x["block"] == y["block"]) & F.arrays_overlap(_grams(x["sign"]), _grams(y["sign"]))
            best.append(F.when(common, similarity(x["sign"], y["sign"])).otherwise(0))
    return F.greatest(*best).cast("int")


def edit_distances(a: np.ndarray, size_a: np.ndarray, masks_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs of signatures, all pairs side by side, by bit vectors of one word.

    ``a`` numbers the rows of ``masks_a`` (``_masks``), ``b`` holds codes; both sizes are at most 64.
    """
    one = np.uint64(1)
    top = one << (np.maximum(size_a, 1) - 1).astype(np.uint64)
    up, down, score = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64), size_a.astype(np.int64)
    for j in range(int(size_b.max()) if len(b) else 0):
        live = size_b > j
        eq = masks_a[a, b[:, j]]
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up), up & h
        score += ((plus & top) != 0) & live
        score -= ((minus & top) != 0) & live
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(v | plus), plus & v
    return np.where(size_a == 0, size_b, score)


def _codes(signs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes 1 to 64 by place, 0 beyond the end; sizes)."""
    size = np.array([len(s) for s in signs], np.int64)
    flat = np.frombuffer("".join(s.ljust(LONG, "\0") for s in signs).encode(), np.uint8).reshape(-1, LONG)
    table = np.zeros(256, np.uint8)
    table[ALPHABET] = np.arange(1, 65)
    return table[flat], size


def _masks(codes: np.ndarray) -> np.ndarray:
    """For each signature and code, the places where the code stands, as bits."""
    out = np.zeros((len(codes), 65), np.uint64)
    for j in range(LONG):
        np.bitwise_or.at(out, (np.arange(len(codes)), codes[:, j]), np.uint64(1) << np.uint64(j))
    out[:, 0] = 0
    return out


def _pair_rows(least: int):
    """Compares all pairs of each group (rows sorted by key, low, high); gives the pairs that score ``least`` or more, the lower number first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _scored(batches, least):
            for i in range(0, rows.shape[1], PAIRS):
                a, s, b = rows[:, i : i + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s.astype(np.int32)), pa.array(b)], names=["a", "score", "b"])

    return run


def _scored(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[np.ndarray]:
    """Rows (signature, score, signature) of each batch of whole groups, each pair once."""

    def solve(table: pa.Table) -> np.ndarray:
        key, low, high, own, rep, pos = (table.column(i).to_numpy() for i in range(6))
        unique = table.column(6).combine_chunks().dictionary_encode()
        codes, size = _codes(unique.dictionary.to_pylist())
        masks, sign = _masks(codes), unique.indices.to_numpy()
        before = np.where(pos > 0, codes[sign, np.maximum(pos - 1, 0)], 0)
        new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        group = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], len(key))[group]
        count = end - np.arange(len(key)) - 1
        found = [np.zeros((3, 0), np.int64)]
        done, total = 0, np.cumsum(count)
        while done < len(key):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
            c = count[done:stop]
            x = np.repeat(np.arange(done, stop), c)
            y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + x + 1
            done = stop
            # a common run is met at each of its 7-grams: it counts where it starts
            starts = (before[x] != before[y]) | (before[x] == 0)
            keep = starts & (rep[x] != rep[y]) & ((low[x] == high[x]) | (own[x] != own[y]))
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            longer = np.maximum(size[sign[x]], size[sign[y]])
            d = edit_distances(sign[x], size[sign[x]], masks, codes[sign[y]], size[sign[y]])
            score = (100 * longer - 100 * d) // longer
            x, y, score = rep[x][score >= least], rep[y][score >= least], score[score >= least]
            found.append(np.array([np.minimum(x, y), score, np.maximum(x, y)]))
        return np.concatenate(found, axis=1)

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        k = np.column_stack([table.column(i).to_numpy() for i in range(3)])
        last = int(np.flatnonzero((k != k[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on in the next batch
        rest = table.slice(last)
        if last:
            yield solve(table.slice(0, last))
    if rest is not None and len(rest):
        yield solve(rest)


def _prepared(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes (doc_id, fingerprint), groups (fid, fingerprint, first, n), members (sid, fid), pairs of signatures (a, b, score)), written."""
    runtime.small_batches(docs.sparkSession)
    prints = runtime.written(fingerprint(docs.where("doc_id IS NOT NULL")), "fingerprints")
    nodes = prints.distinct()
    groups = nodes.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = runtime.written(groups.withColumn("fid", F.monotonically_increasing_id()), "groups")
    # signatures too short for a 7-gram score nothing
    held = groups.select("fid", F.explode(signatures(F.col("fingerprint"))).alias("s")).select("fid", "s.block", "s.sign").where(F.length("sign") >= GRAM)
    signs = runtime.written(held.select("block", "sign").distinct().withColumn("sid", F.monotonically_increasing_id()), "signatures")
    members = runtime.written(held.join(signs, ["block", "sign"]).select("sid", "fid"), "members")
    keyed = signs.select(F.posexplode(_grams(F.col("sign"))).alias("pos", "g"), "sid", "block").select(F.xxhash64("block", "g").alias("key"), "pos", "sid")
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    # A list longer than GROUP is cut into parts, and every two of its parts are a group: no task holds a whole hot list.
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    cut = counted.withColumn("own", F.pmod(F.xxhash64("sid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sid", "pos")
    rows = cut.join(signs.select("sid", "sign"), "sid").select("key", "low", "high", "own", "sid", "pos", "sign")
    groups_in = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    scored = groups_in.mapInArrow(_pair_rows(least), "a long, score int, b long").groupBy("a", "b").agg(F.max("score").alias("score"))
    return nodes, groups, members, runtime.written(scored, "scored")


def _linked(members: DataFrame, scored: DataFrame) -> DataFrame:
    """``(a, b, score)``, a < b: the links between unlike fingerprints, by fid."""
    side = lambda x: members.select(F.col("sid").alias(x), F.col("fid").alias(f"f_{x}"))
    near = scored.join(side("a"), "a").join(side("b"), "b").where("f_a <> f_b").select("f_a", "f_b", "score")
    equal = side("a").join(side("b").withColumnRenamed("b", "a"), "a").where("f_a < f_b").select("f_a", "f_b", F.lit(100).alias("score"))
    both = near.unionByName(equal).select(F.least("f_a", "f_b").alias("a"), F.greatest("f_a", "f_b").alias("b"), "score")
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def links(docs: DataFrame, least: int = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """(``(doc_id, fingerprint)``: all documents, ``(fingerprint_a, fingerprint_b, score)``: the links between unlike fingerprints)."""
    nodes, groups, members, scored = _prepared(docs, least)
    side = lambda x: groups.select(F.col("fid").alias(x), F.col("fingerprint").alias(f"fingerprint_{x}"))
    return nodes, _linked(members, scored).join(side("a"), "a").join(side("b"), "b").select("fingerprint_a", "fingerprint_b", "score")


def classes(docs: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """``(doc_id, fingerprint, class_id, n_links, best_score)``: for every document the least doc_id of its class, the number of documents
    that score ``least`` (1 or more) with it or above, copies among them, and the best of those scores.
    """
    nodes, groups, members, scored = _prepared(docs, least)
    pairs = runtime.written(_linked(members, scored), "pairs")
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    others = both.join(groups.select(F.col("fid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"), F.max("score").alias("best"))
    # Components need no pairs: fingerprints (even numbers) hang together by their signatures (odd ones) and those by their scores.
    edges = members.select((F.col("fid") * 2).alias("a"), (F.col("sid") * 2 + 1).alias("b")).unionByName(scored.select((F.col("a") * 2 + 1).alias("a"), (F.col("b") * 2 + 1).alias("b")))
    tree = runtime.written(components(edges).where("rep % 2 = 0").select((F.col("rep") / 2).cast("long").alias("fid"), "root"), "classes")
    named = tree.join(groups.select("fid", "first"), "fid").groupBy("root").agg(F.min("first").alias("class_id"))
    known = groups.join(tree.join(named, "root").select("fid", "class_id"), "fid", "left").join(others.withColumnRenamed("a", "fid"), "fid", "left")
    count = F.coalesce("others", F.lit(0)) + F.col("n") - 1
    known = known.select("fingerprint", F.coalesce("class_id", "first").alias("class_id"), count.alias("n_links"), F.when(F.col("n") > 1, 100).otherwise(F.col("best")).alias("best_score"))
    out = nodes.join(known, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("best_score").cast("int").alias("best_score"))
