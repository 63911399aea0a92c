"""N-gram Jaccard join: which documents have sets of word n-grams with a Jaccard similarity of at least a threshold.

Links are found by T-occurrence search: a document's partners are those that stand in at least T of its n-grams' inverted
lists. Short lists are merged and counted; the longest are set aside and only probed, by binary search, for the documents
that the short ones leave within reach of T (DivideSkip); what reaches its overlap is a link. Every link at or above the
threshold is found; no list, partner or candidate is capped and nothing is sampled.

A cluster cannot hold the lists of a corpus in one place, so sets first go to blocks that close over similarity:

1. Documents with equal sets collapse to one set with a number of members.
2. In how many sets each n-gram stands is counted over hash parts of packed postings (4 bytes an n-gram and a share of its set's
   key); what returns to the sets is packed likewise, 5 bytes an n-gram. A set of s n-grams shares at least ceil(t * s) with any
   partner, so of those that stand in several sets all but the ceil(t * s) - 1 most frequent are its prefix: two partners have a
   prefix n-gram in common, and so the least set that has it, its owner. Each set goes to the owners of its prefix, as its size and
   a bitmap in which every n-gram flips one bit.
3. At an owner, two sets are candidates unless their sizes or bitmaps prove them apart: the differing bits of two bitmaps are
   never more than the n-grams in which the sets differ. Of the candidate graph only a spanning forest is kept.
4. Connected components of the forests, by alternating large-star and small-star steps on written tables, are the blocks; each
   whole set goes once to its block, where the search above runs over whole inverted lists.

Hot keys: an n-gram that many sets have (``hot_grams``) is never gathered in one task: its postings keep their places, as the last
in the order of frequency. Owners with more than ``GROUP`` sets are cut into parts, and every two parts are compared in a task of
their own; blocks of more than ``BLOCK_GRAMS`` n-grams likewise. Equal sets are dropped from a task's postings where they are read.

The result has one row a document: its class (the least doc_id that links lead to) and its number of links, so copies are not
expanded into pairs; ``links`` gives the links between sets themselves.

A word is a run of characters other than white space; a text of fewer than n words has its words as its only n-gram. N-grams and
sets are compared by hashes of 64 and 128 bits.

Edge cases: null and empty texts have no n-gram: a class of their own, without links; rows with a null doc_id take no part (``keep_one``
keeps them); equal rows are one document; rows of one doc_id with different texts are documents of their own, each with its row,
and may be linked; ties do not arise, for all links count, and the least doc_id of a class names it; an empty table
gives an empty result; very long texts are whole; other columns are not read. A threshold outside (0, 1] or n below 1 raises ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime, textops
from glossa.llm.graph import components

N, THRESHOLD = 3, 0.5
SKIP_MU = 0.1
PART_GRAMS, FLUSH_GRAMS, BLOCK_GRAMS = 1 << 22, 1 << 20, 1 << 22
SORT_GRAMS, ROW_GRAMS, BUCKETS = 1 << 21, 1 << 15, 4
GROUP = 2048
HOT_SLICE, HOT_SHARE, HOT_LEAST = 64, 32, 1 << 16
_HOT_RANK = 255
_LOW = np.uint64(0xFFFFFFFF)


# ---- sets -----------------------------------------------------------------------------------------------------


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    for _, group in textops.slices(texts):
        h, _, _, first, _ = textops.words(group)
        g, fits = textops.ngrams(h, first, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            # the n-gram hash of a shorter text's first word covers just its words
            own = g[a : b - n + 1] if b - a >= n else textops.ngrams(h[a:b], np.array([0, b - a]), n)[0][:1]
            yield np.unique(own)


def set_key(grams: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh128_digest(grams.tobytes()), np.int64)


def bits_per_gram(threshold: float) -> int:
    return 4 if threshold >= 0.4 else 16


def bitmap(grams: np.ndarray, per: int) -> bytes:
    """Each n-gram flips the bit of its hash modulo a power of two; halves of a longer bitmap fold to a shorter one by xor."""
    size = 1 << max(6, (len(grams) * per - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


SKETCH = "doc_id long, key_a long, key_b long, size int, quota int, bits binary"


def _sketch_rows(n: int, threshold: float):
    """One row a document; and n-grams that many of a slice's sets have, as rows of size -1 (n-gram, count)."""
    per, names = bits_per_gram(threshold), [x.split()[0] for x in SKETCH.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.parts(batches):
            rows, distinct = [], {}
            for d, s in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1).to_pylist(), n)):
                if not len(s):
                    rows.append((d, 0, 0, 0, 0, b""))
                    continue
                a, b = set_key(s).tolist()
                distinct[a] = s
                # n-grams that share the low half of their hash are one posting: so many fewer are set aside
                quota = _needed(len(s), threshold) - 1 - (len(s) - len(np.unique(s & _LOW)))
                rows.append((d, a, b, len(s), quota, bitmap(s, per)))
            if distinct:
                least = max(16, len(distinct) // HOT_SLICE)
                if len(distinct) >= least:
                    gram, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                    hot = count >= least
                    rows += [(None, g, c, -1, 0, b"") for g, c in zip(gram[hot].view(np.int64).tolist(), count[hot].tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        runtime.release()

    return run


def hot_grams(sketches: DataFrame, n_sets: int) -> np.ndarray:
    """The n-grams that stand in a ``HOT_SHARE``-th of the sets or more by the slices' counts, sorted.

    At most ``HOT_SHARE`` times the mean size of a set are hot, whatever the corpus; which are is a matter of routing and of order
    only, not of the result.
    """
    counted = sketches.where("size = -1").groupBy("key_a").agg(F.sum("key_b").alias("n")).where(F.col("n") >= max(HOT_LEAST, n_sets // HOT_SHARE))
    return np.sort(np.array([r[0] for r in counted.select("key_a").collect()], np.int64).view(np.uint64))


# ---- frequencies and prefixes ---------------------------------------------------------------------------------

BLOB = "part int, hot boolean, keys binary, counts binary, ids binary"
POSTINGS = "bucket int, keys binary, counts binary, owners binary, ranks binary"


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where ``new`` is set; longer runs are cut to lengths that a byte holds."""
    at = np.flatnonzero(new)
    cuts = (np.diff(np.append(at, len(new))) + 254) // 255
    start = np.repeat(at, cuts) + 255 * (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    return start, np.diff(np.append(start, len(new))).astype(np.uint8)


def _blob_rows(n: int, parts: int, hot: np.ndarray):
    """Postings packed by the part of their n-gram's hash: keys of the sets, number of n-grams of each, low halves of the n-grams."""

    def flush(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        key, g = np.array(keys, np.int64), np.concatenate(sets)
        doc = np.repeat(np.arange(len(keys)), [len(s) for s in sets])
        is_hot = np.zeros(len(g), bool)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
        part = ((g >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) * 2
        if len(hot):  # a hot n-gram stays with its set
            part[is_hot] = (key[doc[is_hot]].view(np.uint64) % np.uint64(parts)).astype(np.int64) * 2 + 1
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 15 else part, kind="stable")
        part, doc, low = part[order], doc[order], (g[order] & _LOW).astype(np.uint32)
        at, counts = _runs(np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
        owner, of = key[doc[at]], part[at]
        begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] // ROW_GRAMS != at[:-1] // ROW_GRAMS)))
        end, start = np.append(begin[1:], len(of)), np.append(at, len(part))
        rows = [(int(of[b]) // 2, bool(of[b] & 1), owner[b:e].tobytes(), counts[b:e].tobytes(), low[start[b] : start[e]].tobytes()) for b, e in zip(begin.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()])], names=["part", "hot", "keys", "counts", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, sets, total = set(), [], [], 0
        for batch in runtime.parts(batches):
            for s in gram_sets(batch.column(0).to_pylist(), n):
                if not len(s):
                    continue
                key = int(set_key(s)[0])
                if key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(s)
                total += len(s)
                if total >= FLUSH_GRAMS:
                    yield flush(keys, sets)
                    keys, sets, total = [], [], 0
        if keys:
            yield flush(keys, sets)
        runtime.release()

    return run


def _posting_rows(buckets: int):
    """Of each part, the postings of n-grams in several sets, packed by the bucket of their set's key. Rows come sorted by part.

    A posting is 5 bytes: the low half of its owner's key, and its rank, in eighths of an octave of the frequency. N-grams of a rank
    are in the order of their owners, so those that tie lead to the same owner.
    """

    def packed(every: np.ndarray, set_no: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        bucket = every % buckets
        place = np.empty(len(every), np.uint64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(every), dtype=np.uint64)
        x = place[set_no] << np.uint64(32)
        x |= np.arange(len(x), dtype=np.uint64)
        x.sort()
        order = (x & _LOW).astype(np.int64)
        set_no, owner, rank = set_no[order], owner[order], rank[order]
        at, counts = _runs(np.append(True, set_no[1:] != set_no[:-1])[: len(set_no)])
        key, of = every[set_no[at]], bucket[set_no[at]]
        begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] // ROW_GRAMS != at[:-1] // ROW_GRAMS))[: len(of)])
        end, start = np.append(begin[1:], len(of)), np.append(at, len(set_no))
        rows = [(int(of[b]), *(x.tobytes() for x in (key[b:e], counts[b:e], owner[start[b] : start[e]], rank[start[b] : start[e]]))) for b, e in zip(begin.tolist(), end.tolist())]
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["bucket", "keys", "counts", "owners", "ranks"])

    def solve(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        every, own = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k, _, _ in rows]), return_inverse=True)
        own = own.astype(np.uint64)
        x, at, head = np.empty(sum(len(i) for _, _, i in rows) // 4, np.uint64), 0, 0
        for _, c, i in rows:
            some = x[at : at + len(i) // 4]
            some[:] = np.frombuffer(i, np.uint32)
            some <<= np.uint64(32)
            some |= np.repeat(own[head : head + len(c)], np.frombuffer(c, np.uint8))
            at, head = at + len(some), head + len(c)
        rows.clear()
        x.sort()
        out, a = [], 0
        while a < len(x):  # so many postings at a time, whole lists
            b = int(np.searchsorted(x, x[min(a + SORT_GRAMS, len(x)) - 1] | _LOW, side="right"))
            out.append(shared(x[a:b], every))
            a = b
        return packed(every, *(np.concatenate(c) for c in zip(*out)))

    def shared(x: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, owner, rank) of the n-grams in several sets."""
        x = x[np.append(True, x[1:] != x[:-1])]
        gram = x >> np.uint64(32)
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        df = np.diff(np.append(at, len(x)))
        many = df > 1
        size = df[many]
        place = np.repeat(at[many] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        least = every[(x[at[many]] & _LOW).astype(np.int64)]  # sets are numbered in the order of keys
        rank = np.minimum(8 * np.log2(size), _HOT_RANK - 1).astype(np.uint8)
        return (x[place] & _LOW).astype(np.uint32), np.repeat((least.view(np.uint64) & _LOW).astype(np.uint32), size), np.repeat(rank, size)

    def echo(keys: bytes, counts: bytes, ids: bytes) -> pa.RecordBatch:
        """A hot n-gram owns itself."""
        every, own = np.unique(np.frombuffer(keys, np.int64), return_inverse=True)
        low = np.frombuffer(ids, np.uint32)
        owner = (textops.mix(low.astype(np.uint64)) & _LOW).astype(np.uint32)
        return packed(every, np.repeat(own, np.frombuffer(counts, np.uint8)), owner, np.full(len(low), _HOT_RANK, np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for part, hot, keys, counts, ids in zip(*batch.columns):
                if hot.as_py():
                    yield echo(keys.as_py(), counts.as_py(), ids.as_py())
                    continue
                if part.as_py() != last and rows:
                    yield solve(rows)
                last = part.as_py()
                rows.append((keys.as_py(), counts.as_py(), ids.as_py()))
        if rows:
            yield solve(rows)
        runtime.release()

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(owner, key)``: the owners of each set's prefix. Rows (bucket, key, quota, and packed postings) come sorted by bucket."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys, counts, owners, ranks = (np.frombuffer(b"".join(x for x in table.column(i).to_pylist() if x), t) for i, t in ((3, np.int64), (4, np.uint8), (5, np.uint32), (6, np.uint8)))
        every, number = np.unique(keys, return_inverse=True)
        known = table.filter(table.column(1).is_valid())
        key, quota = known.column(1).to_numpy(), known.column(2).to_numpy()
        place = np.searchsorted(every, key)
        some = every[np.minimum(place, len(every) - 1)] == key if len(every) else np.zeros(len(key), bool)
        aside = np.full(len(every), 1 << 30)
        np.minimum.at(aside, place[some], quota[some])
        aside = np.maximum(aside, 0)
        of, owner = np.repeat(number, counts), owners.astype(np.int64)
        rank = ranks.astype(np.int64) << 32 | owner
        order = np.lexsort((-rank, of))
        of, owner, rank = of[order], owner[order], rank[order]
        total = np.bincount(of, minlength=len(every))
        begin = np.cumsum(total) - total
        some = total > aside
        most = np.full(len(every), -1, np.int64)
        most[some] = rank[(begin + aside)[some]]
        keep = rank <= most[of]  # all that tie with the first one kept
        of, owner = of[keep], owner[keep]
        order = np.lexsort((owner, of))
        of, owner = of[order], owner[order]
        once = np.append(True, (of[1:] != of[:-1]) | (owner[1:] != owner[:-1]))[: len(of)]
        return pa.RecordBatch.from_arrays([pa.array(owner[once]), pa.array(every[of[once]])], names=["owner", "key"])

    for table in _whole_groups(batches, 1):
        yield solve(table)
    table = None
    runtime.release()


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables that end where the first columns change; the input is sorted by them."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(i).to_numpy() for i in range(columns)])
        last = int(np.flatnonzero((k != k[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on in the next batch
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        elif waiting and (np.array([waiting[-1].column(i)[-1].as_py() for i in range(columns)]) != k[0]).any():
            yield pa.Table.from_batches(waiting)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _owned(texts: DataFrame, sketches: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``(owner, key)`` for every set that shares a prefix n-gram, written."""
    n_sets, grams = sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot, parts = hot_grams(sketches, n_sets), grams // PART_GRAMS + 1
    blobs = texts.select("text").mapInArrow(_blob_rows(n, parts, hot), BLOB)
    # a task for each part: by hash, some tasks would get several
    gathered = blobs.repartitionById(2 * parts, 2 * F.col("part") + F.col("hot").cast("int")).sortWithinPartitions("part", "hot")
    buckets = BUCKETS * parts
    postings = gathered.mapInArrow(_posting_rows(buckets), POSTINGS)
    quotas = sets.select(F.pmod("key_a", F.lit(buckets)).cast("int").alias("bucket"), F.col("key_a").alias("key"), "quota")
    by_set = quotas.unionByName(postings, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    return runtime.written(by_set.mapInArrow(_prefix_rows, "owner long, key long"), "owned")


# ---- candidates -----------------------------------------------------------------------------------------------


class Forest:
    """Groups of numbers under union."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Puts others in a's group; the first of each group that was another."""
        groups, first = np.unique(self.label[others], return_index=True)
        fresh = groups != self.label[a]
        if not fresh.any():
            return others[:0]
        self.label[np.isin(self.label, groups[fresh])] = self.label[a]
        return others[first[fresh]]


def candidate_edges(key: np.ndarray, size: np.ndarray, bits: list[bytes], own: np.ndarray, cross: bool, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and bitmaps leave the threshold within reach; ``cross``: only pairs of unlike ``own``."""
    order = np.argsort(size, kind="stable")
    key, size, own = key[order], size[order].astype(np.int64), own[order]
    width = np.array([len(bits[i]) // 8 for i in order])
    maps: dict[int, np.ndarray] = {}
    forest, out = Forest(len(key)), []

    def folded(w: int) -> np.ndarray:
        """The bitmaps from the first of this width on, folded to it."""
        if w not in maps:
            at = int(np.searchsorted(width, w))
            rows = np.empty((len(key) - at, w), np.uint64)
            for v in np.unique(width[at:]):
                a, b = np.searchsorted(width, [v, v + 1])
                x = np.frombuffer(b"".join(bits[order[i]] for i in range(a, b)), np.uint64).reshape(b - a, v)
                rows[a - at : b - at] = np.bitwise_xor.reduce(x.reshape(b - a, v // w, w), axis=1)
            maps.clear()
            maps[w] = rows
        return maps[w]

    for i in range(len(key) - 1):
        high = int(np.searchsorted(size, size[i] / threshold + 1e-6, side="right"))
        j = np.arange(i + 1, high)
        j = j[forest.label[j] != forest.label[i]]
        j = j[own[j] != own[i]] if cross else j
        if not len(j):
            continue
        w = int(width[i])
        rows, at = folded(w), int(np.searchsorted(width, w))
        bound = (1 - threshold) / (1 + threshold) * (size[i] + size[j]) + 1e-6
        near = np.zeros(len(j), bool)
        for a in range(0, len(j), step := max(1, (1 << 21) // w)):
            near[a : a + step] = np.bitwise_count(rows[j[a : a + step] - at] ^ rows[i - at]).sum(1) <= bound[a : a + step]
        for y in forest.join(i, j[near]).tolist() if near.any() else ():
            out.append((int(key[i]), int(key[y])))
    return out


def _edge_rows(threshold: float):
    """Rows (owner, low, high, own, key, size, bits) come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3):
            owner, low, high, own, key, size = (table.column(i).to_numpy() for i in range(6))
            bits = table.column(6).to_pylist()
            at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            out = []
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(owner)]):
                if b - a > 1:
                    out += candidate_edges(key[a:b], size[a:b], bits[a:b], own[a:b], bool(low[a] != high[a]), threshold)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        runtime.release()

    return run


def _edges(owned: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    counts = owned.groupBy("owner").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    bits = sketches.where("size > 0").select(F.col("key_a").alias("key"), "size", "bits").dropDuplicates(["key"])
    shared = owned.join(counts, "owner").join(bits, "key")
    cut = shared.withColumn("own", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("owner", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key", "size", "bits")
    groups = cut.repartition("owner", "low", "high").sortWithinPartitions("owner", "low", "high")
    return groups.mapInArrow(_edge_rows(threshold), "a long, b long").where("a <> b")


# ---- search in a block ----------------------------------------------------------------------------------------


def divide_skip(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, overlaps) for each set i that has partners among the sets not smaller than it; every linked pair comes once."""
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in by_size], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
    order = np.argsort(gram, kind="stable")  # each inverted list in the order of size
    lists, start = owner[order], np.append(0, np.cumsum(np.bincount(gram)))
    begin = np.append(0, np.cumsum(size))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for x in range(len(sets)):
        own = gram[begin[x] : begin[x + 1]]
        low, high = place[begin[x] : begin[x + 1]] + 1, start[own + 1]  # only sets after x: not smaller ones
        some = high > low
        low, high = low[some], high[some]
        need = math.ceil(2 * threshold / (1 + threshold) * size[x] - 1e-9)
        if len(low) < need:
            continue
        length = high - low
        aside = min(need - 1, int(need / (SKIP_MU * math.log2(int(length.max()) + 1) + 1)))
        sort = np.argsort(length, kind="stable")
        short, long = sort[: len(sort) - aside], sort[len(sort) - aside :]
        n = length[short]
        rows = np.arange(int(n.sum())) + np.repeat(low[short] - (np.cumsum(n) - n), n)
        count = np.bincount(lists[rows] - x, minlength=1)
        found = np.flatnonzero(count >= max(1, need - aside))
        count = count[found]
        y = found + x
        for i in long.tolist():
            if not len(y):
                break
            one = lists[low[i] : high[i]]
            at = np.minimum(np.searchsorted(one, y), len(one) - 1)
            count += one[at] == y
        share = count >= threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9
        if share.any():
            yield int(by_size[x]), by_size[y[share]], count[share]


def _block_rows(solve: Callable[[np.ndarray, np.ndarray, np.ndarray, bool, list[np.ndarray]], list[tuple]], schema: pa.Schema):
    """Runs ``solve`` on (set ids, members, parts, whether only unlike parts meet, sets) of each block; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def finish(block: list[tuple], cross: bool) -> list[tuple]:
            sid, n, own, grams = zip(*{b[0]: b for b in block}.values())
            return solve(np.array(sid, np.int64), np.array(n, np.int64), np.array(own), cross, [np.frombuffer(g, np.uint64) for g in grams])

        block, last = [], None
        for batch in batches:
            for root, low, high, own, sid, n, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, low, high) != last:
                    rows += finish(block, last[1] != last[2]) if block else []
                    block, last = [], (root, low, high)
                    if len(rows) >= 50_000:
                        yield batch_of(rows)
                        rows = []
                block.append((sid, n, own, grams))
        rows += finish(block, last[1] != last[2]) if block else []
        for at in range(0, len(rows), 50_000):
            yield batch_of(rows[at : at + 50_000])
        block = rows = None
        runtime.release()

    return run


def _blocks(texts: DataFrame, sets: DataFrame, roots: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """((root, low, high, own, sid, n, grams) sorted by block, whether any block is cut into parts)."""
    own = sets.join(roots.withColumnRenamed("rep", "key_a"), "key_a")
    total = own.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK_GRAMS).cast("int").alias("parts"))
    plan = runtime.written(own.join(total, "root").select("root", "parts", "sid", "n", "key_a", "key_b", F.col("first").alias("doc_id")), "plan")
    is_cut = plan.where("parts > 1").limit(1).count() > 0
    names = ["root", "parts", "sid", "n", "grams"]

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.parts(batches):
            sets = list(gram_sets(batch.column(6).to_pylist(), n))
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            # a doc_id with several texts meets the plans of all of them: each text keeps its own
            right = pa.array([len(s) > 0 and set_key(s).tolist() == [x, y] for s, x, y in zip(sets, a, b)])
            whole = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())], names=names)
            yield whole.filter(right)
        runtime.release()

    side = runtime.small_side(plan, 56)  # without a shuffle of the texts while the list of documents is small
    sets = texts.join(side, "doc_id").select("root", "parts", "sid", "n", "key_a", "key_b", "text").mapInArrow(full, "root long, parts int, sid long, n long, grams binary")
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    cut = sets.withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sid", "n", "grams")
    return cut.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high"), is_cut


def _prepared(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(nodes (doc_id, key_a, key_b, size), sets, blocks, whether any is cut)."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError(f"threshold {threshold} and n {n}: 0 < threshold <= 1 and n >= 1 are expected")
    runtime.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    sketches = runtime.written(texts.mapInArrow(_sketch_rows(n, threshold), SKETCH), "sketches")
    nodes = sketches.where("size >= 0").select("doc_id", "key_a", "key_b", "size")
    one = sketches.where("size > 0").select("key_a", "key_b", "doc_id", "size", "quota").repartition("key_a", "key_b").distinct()
    sets = one.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("quota").alias("quota"))
    sets = runtime.written(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    owned = _owned(texts.where("text IS NOT NULL"), sketches, sets, n)
    roots = runtime.written(components(_edges(owned, sketches, threshold)), "roots")
    runtime.drop(owned)
    blocks, is_cut = _blocks(texts.where("text IS NOT NULL"), sets, roots, n)
    return nodes, sets, blocks, is_cut


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(``(doc_id, set_id)``: the documents of each set, ``(set_a, set_b, jaccard)``: all links between different sets)."""
    schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("jaccard", pa.float64())])

    def solve(sid: np.ndarray, members: np.ndarray, own: np.ndarray, cross: bool, sets: list[np.ndarray]) -> list[tuple]:
        out = []
        for i, js, overlap in divide_skip(sets, threshold):
            for j, o in zip(js.tolist(), overlap.tolist()):
                if not cross or own[i] != own[j]:
                    a, b = sorted((int(sid[i]), int(sid[j])))
                    out.append((a, b, o / (len(sets[i]) + len(sets[j]) - o)))
        return out

    nodes, sets, blocks, _ = _prepared(docs, threshold, n)
    members = nodes.where("size > 0").join(sets, ["key_a", "key_b"]).select("doc_id", F.col("sid").alias("set_id")).distinct()
    return members, blocks.mapInArrow(_block_rows(solve, schema), "set_a long, set_b long, jaccard double")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``(doc_id, class_id, n_links)``: for every document, the least doc_id of its class and the number of its links, copies among them."""
    schema = pa.schema([("sid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def solve(sid: np.ndarray, members: np.ndarray, own: np.ndarray, cross: bool, sets: list[np.ndarray]) -> list[tuple]:
        count, forest = np.zeros(len(sid), np.int64), Forest(len(sid))
        for i, js, _ in divide_skip(sets, threshold):
            js = js[own[js] != own[i]] if cross else js
            if len(js):
                count[i] += members[js].sum()
                count[js] += members[i]
                forest.join(i, js)
        root = np.full(len(sid), np.iinfo(np.int64).max)
        np.minimum.at(root, forest.label, sid)
        some = count > 0
        return list(zip(sid[some].tolist(), root[forest.label[some]].tolist(), count[some].tolist()))

    nodes, sets, blocks, is_cut = _prepared(docs, threshold, n)
    found = runtime.written(blocks.mapInArrow(_block_rows(solve, schema), "sid long, root long, links long"), "links")
    if is_cut:  # the parts' groups meet in common sets
        tree = components(found.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
        tree = runtime.written(tree.withColumnRenamed("rep", "sid"), "classes")
        found = found.groupBy("sid").agg(F.sum("links").alias("links")).join(tree, "sid")
    named = found.join(sets.select("sid", "first"), "sid").groupBy("root").agg(F.min("first").alias("class_id"))
    of_set = found.join(named, "root").select("sid", "class_id", "links")
    known = sets.select("key_a", "key_b", "sid", "first", "n").join(of_set, "sid", "left")
    known = known.select("key_a", "key_b", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    with_set = nodes.where("size > 0").select("doc_id", "key_a", "key_b").distinct().join(known, ["key_a", "key_b"])
    without = nodes.where("size = 0").select("doc_id").distinct()
    return with_set.select("doc_id", "class_id", "n_links").unionByName(without.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The documents without those whose class has a smaller doc_id: the least of each class stays.

    A doc_id with several texts goes only if each of them is in the class of a smaller doc_id. Rows with a null doc_id and null or
    empty texts stay; repeated rows go or stay together.
    """
    most = classes(docs, threshold, n).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("class_id").alias("_class")).where("_class < _gone")
    name = runtime.fresh("_gone", docs)
    gone = runtime.written(most.select(F.col("_gone").alias(name)), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE o >= {THRESHOLD} * (x.n + y.n - o)),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
