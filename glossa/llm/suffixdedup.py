"""Suffix-array dedup: passages of at least ``min_words`` words that several documents share.

Repeats are found on the Burrows-Wheeler transform of word sequences by threshold-bounded interval expansion: the
intervals of all words of length 0, 1, 2, ... are extended backward, breadth first; each extended interval whose right
border has no value yet gives that border its common-prefix length, so these come in increasing order, and the expansion
stops at the minimum length. Borders still without a value then join suffixes that share at least that many words.

To spread this over a cluster, only text that can hold a repeat reaches a transform. Each document's anchors are
the k-grams that are least, by hash, in some window as long as a passage (winnowing): two occurrences of a passage
share the least k-gram of any window in them. Anchors of one document only are dropped; every other anchor is owned by the
least doc_id that has it, and a document sends to each owner the stretches around that owner's anchors, wide enough for every
passage through them. All occurrences of a window thus meet in the bucket of its least anchor's owner, so the result
is exact, and equal stretches enter the transform once. Shuffled are anchor hashes, the texts (once, by doc_id) and the
stretches' word hashes.

Hot keys: an owner of anchors with more than ``OWNER_DOCS`` occurrences has its anchors dealt to several buckets. An anchor that more than
``HOT_DOCS`` rows have (a license that a third of all documents carry) is put in no bucket: the windows through it are compared
by 128-bit hashes in a plain aggregation, which finds the same windows.

A word is a run of characters other than white space, compared by a 64-bit hash. The result has one row for each maximal
range of words: (doc_id, text_id, start_word, end_word, first_copy), where text_id is the text's 64-bit hash. ``first_copy`` ranges are those that stay: their windows occur in
no smaller doc_id; the others are what a dedup cuts (``cut_repeats``).

Edge cases: null and empty texts and texts under ``min_words`` words have no ranges; rows with a null doc_id are left out;
rows of one doc_id are one document, so they do not repeat each other, nor does a passage repeat within its document; ranges are words
of the text that text_id names, so unlike texts of one doc_id are cut each by its own; equal rows have their ranges once;
ties do not arise (ids order the copies); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import runtime, textops

MIN_WORDS, ANCHOR_WORDS = 50, 16
HOT_DOCS, OWNER_DOCS = 1 << 13, 1 << 14
BATCH_WORDS = 1 << 19
_MAX = np.uint64(2**64 - 1)


# ---- transform and interval expansion -------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` symbols, by prefix doubling; ties by position.

    Backward extension to words of at most ``depth`` symbols needs no deeper order.
    """
    n = len(symbols)
    rank, h = symbols.astype(np.int64), 1
    while h < depth:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1:
            break
    return np.argsort(rank, kind="stable")


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common-prefix lengths of each suffix with the one before it in ``order``; -1 where at least ``least``."""
    n = len(symbols)
    bwt = symbols[order - 1]  # position 0 is preceded by the last symbol, a separator
    first = symbols[order]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        done = np.cumsum(size)
        own = np.repeat(np.arange(len(low)), size)
        rows = np.arange(total) + np.repeat(low - (done - size), size)
        # The rows of one interval with one symbol before them map to consecutive rows: the extended interval.
        to = lf[rows]
        sort = np.argsort(to)
        to, own = to[sort], own[sort]
        new = np.empty(total, bool)
        new[0] = True
        new[1:] = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (first[to[1:]] != first[to[:-1]])
        at = np.flatnonzero(new)
        begin = to[at]
        end = to[np.append(at[1:], total) - 1] + 1
        fresh = (lcp[end] < 0) | (length == 0)
        low, high = begin[fresh], end[fresh]
        unset = high[lcp[high] < 0]
        lcp[unset] = length
    return lcp[:n]


def repeated_windows(segments: list[np.ndarray], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, cut) of each window of ``least`` words that segments of several documents share.

    ``segments`` are arrays of word hashes, ``docs`` their documents; ``cut``: a smaller document has the window too.
    """
    size = np.array([len(s) for s in segments])
    m = len(segments)
    _, ids = np.unique(np.concatenate(segments), return_inverse=True)
    ends = np.cumsum(size + 1) - 1
    symbols = np.empty(ends[-1] + 1, np.int64)
    word = np.ones(len(symbols), bool)
    word[ends] = False
    symbols[word] = ids + m
    symbols[ends] = np.arange(m)  # each segment ends in a separator of its own
    order = suffix_order(symbols, least)
    lcp = shared_prefixes(symbols, order, least)
    group = np.cumsum(lcp >= 0) - 1
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    segment = np.searchsorted(ends, order)
    doc = docs[segment]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least_doc, most_doc = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    which = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    across = (least_doc != most_doc)[which]
    start = order - (ends - size)[segment]
    return segment[across], start[across], (doc != least_doc[which])[across]


# ---- anchors --------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``pick`` over x[i : i + width] for every i; beyond the end stands ``fill``."""
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full(len(x), fill, np.uint64)
        shifted[: len(x) - step] = x[step:]
        x = pick(x, shifted)
        have += step
    return x


def anchors(h: np.ndarray, first: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes) of the k-grams that are least in some window of ``least`` words of a document."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, fits = textops.ngrams(h, first, k)
    g[~fits] = _MAX
    width = least - k + 1
    window = _slide(g, width, np.minimum, _MAX)
    valid = np.arange(len(h)) + least <= np.repeat(first[1:], np.diff(first))
    window[~valid] = 0
    best = _slide(window[::-1], width, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((best == g) & fits & (best > 0))
    return at, g[at]


def _anchor_rows(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, group in textops.slices(batch.column(1).to_pylist()):
                h, _, _, first, _ = textops.words(group)
                where, hashes = anchors(h, first, least, k)
                doc = np.searchsorted(first, where, side="right") - 1
                sort = np.lexsort((hashes, doc))
                doc, hashes = doc[sort], hashes[sort]
                keep = np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))[: len(doc)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(ids[at + doc[keep]])], names=["anchor", "doc_id"])

    return run


def _stretch_rows(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, texts = (batch.column(i).to_pylist() for i in range(3))
            pairs = batch.column(3)
            bounds = pairs.offsets.to_numpy()
            flat = pairs.values
            known, owners = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
            for base, group in textops.slices(texts):
                h, _, _, first, _ = textops.words(group)
                where, hashes = anchors(h, first, least, k)
                split = np.searchsorted(where, first)
                out: list[tuple] = []
                for d in range(len(group)):
                    a, b = bounds[base + d], bounds[base + d + 1]
                    sort = np.argsort(known[a:b])
                    mine, own = known[a:b][sort], owners[a:b][sort]
                    pos, value = where[split[d] : split[d + 1]], hashes[split[d] : split[d + 1]]
                    i = np.minimum(np.searchsorted(mine, value), len(mine) - 1)
                    hit = mine[i] == value
                    pos, own = pos[hit], own[i[hit]]
                    if not len(pos):
                        continue
                    sort = np.lexsort((pos, own))
                    pos, own = pos[sort], own[sort]
                    low = np.maximum(pos - (least - k), first[d])
                    high = np.minimum(pos + least, first[d + 1])
                    new = np.append(True, (own[1:] != own[:-1]) | (low[1:] > high[:-1]))
                    at = np.flatnonzero(new)
                    ends = high[np.append(at[1:], len(pos)) - 1]
                    for o, s, e in zip(own[at].tolist(), low[at].tolist(), ends.tolist()):
                        out.append((o, ids[base + d], names[base + d], s - first[d], h[s:e].tobytes()))
                if out:
                    o, i, t, s, w = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(np.array(s, np.int64)), pa.array(w, pa.binary())], names=["owner", "doc_id", "text_id", "start", "words"])

    return run


def _window_rows(least: int, k: int):
    """``(a, b, doc_id, text_id, start)``: two hashes of every window through the anchors given with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            texts, known = batch.column(2).to_pylist(), batch.column(3)
            bounds, flat = known.offsets.to_numpy(), known.values.to_numpy().view(np.uint64)
            for base, group in textops.slices(texts):
                h, _, _, first, _ = textops.words(group)
                where, hashes = anchors(h, first, least, k)
                doc = np.searchsorted(first, where, side="right") - 1
                a = textops.ngrams(h, first, least)[0]
                b, fits = textops.ngrams(textops.mix(h ^ _MAX), first, least)
                hot = np.zeros(len(h), bool)
                for d in range(len(group)):
                    mine = doc == d
                    for x in where[mine][np.isin(hashes[mine], flat[bounds[base + d] : bounds[base + d + 1]])].tolist():
                        hot[max(x - (least - k), first[d]) : x + 1] = True
                at = np.flatnonzero(hot & fits)
                of = np.searchsorted(first, at, side="right") - 1
                columns = [a[at].view(np.int64), b[at].view(np.int64), ids[base + of], names[base + of], at - first[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "doc_id", "text_id", "start"])

    return run


def _bucket_rows(least: int):
    """Transforms whole owners' stretches, about ``BATCH_WORDS`` words at a time; input is sorted by owner."""
    names = ["doc_id", "text_id", "start", "stop", "cut"]

    def solve(segments: dict[bytes, list[tuple[int, int, int]]]) -> pa.RecordBatch:
        # Equal stretches enter once, as the least and, if there is another, the largest of their documents.
        unique = list(segments.items())
        docs, arrays, source = [], [], []
        for u, (words, members) in enumerate(unique):
            ids = [m[0] for m in members]
            for d in {min(ids), max(ids)}:
                docs.append(d)
                arrays.append(np.frombuffer(words, np.uint64))
                source.append(u)
        segment, start, cut = repeated_windows(arrays, np.array(docs, np.int64), least)
        key = np.array(source, np.int64)[segment]
        least_doc = np.array([min(m[0] for m in members) for _, members in unique], np.int64)
        cut = cut | False
        # windows of a stretch, once; the least document of all that have it is cut only if the least copy is
        sort = np.lexsort((cut, start, key))
        key, start, cut = key[sort], start[sort], cut[sort]
        keep = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1]))[: len(key)]
        key, start, cut = key[keep], start[keep], cut[keep]
        out: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
        if len(key):
            new = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (cut[1:] != cut[:-1]))
            at = np.flatnonzero(new)
            stop = start[np.append(at[1:], len(key)) - 1] + 1
            for u, s, e, c in zip(key[at].tolist(), start[at].tolist(), stop.tolist(), cut[at].tolist()):
                members = np.array(unique[u][1], np.int64)
                out.append(np.column_stack([members[:, 0], members[:, 1], members[:, 2] + s, members[:, 2] + e, (members[:, 0] != least_doc[u]) | c]))
        rows = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(rows[:, 4].astype(bool))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[bytes, list[tuple[int, int, int]]] = {}
        size, last = 0, None
        for batch in batches:
            for o, d, t, s, w in zip(*(c.to_pylist() for c in batch.columns)):
                if o != last and size >= BATCH_WORDS:
                    yield solve(segments)
                    segments, size = {}, 0
                last = o
                if w not in segments:
                    segments[w] = []
                    size += len(w) // 8
                segments[w].append((d, t, s))
        if segments:
            yield solve(segments)

    return run


def _range_rows(least: int):
    """Merges a document's window starts to ranges of words."""

    def union(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for s, e in sorted(starts):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [(s, e) for s, e in out]

    def minus(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for s, e in a:
            for x, y in b:
                if y <= s or x >= e:
                    continue
                if x > s:
                    out.append((s, x))
                s = max(s, y)
            if s < e:
                out.append((s, e))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cut = union([(r["start"], r["stop"]) for r in rows if r["cut"]])
                rest = minus(union([(r["start"], r["stop"]) for r in rows if not r["cut"]]), cut)
                for kept, starts in ((False, cut), (True, rest)):
                    out += [(d, t, s, e, kept) for s, e in union([(s, e - 1 + least) for s, e in starts])]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], names=["doc_id", "text_id", "start_word", "end_word", "first_copy"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, text_id, start_word, end_word, first_copy)``: the ranges of words that other documents have too."""
    k = min(anchor_words, min_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = runtime.written(texts.select("doc_id", "text").mapInArrow(_anchor_rows(min_words, k), "anchor long, doc_id long"), "anchors")
    owned = found.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"), F.count("*").alias("n"))
    owned = runtime.written(owned.where("owner < _last").drop("_last"), "owned")
    cool, hot = owned.where(F.col("n") <= HOT_DOCS), owned.where(F.col("n") > HOT_DOCS).select("anchor")
    parts = cool.groupBy("owner").agg(F.ceil(F.sum("n") / OWNER_DOCS).cast("int").alias("parts"))
    bucket = F.xxhash64("owner", F.pmod(F.xxhash64("anchor"), F.col("parts")))
    cool = cool.join(parts, "owner").select("anchor", bucket.alias("owner"))
    wanted = found.join(cool, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "owner")).alias("pairs"))
    stretches = texts.join(wanted, "doc_id").select("doc_id", "text_id", "text", "pairs").mapInArrow(_stretch_rows(min_words, k), "owner long, doc_id long, text_id long, start long, words binary")
    buckets = stretches.repartition("owner").sortWithinPartitions("owner")
    windows = buckets.mapInArrow(_bucket_rows(min_words), "doc_id long, text_id long, start long, stop long, cut boolean")
    if hot.limit(1).count():
        given = found.join(hot, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        given = texts.join(given, "doc_id").select("doc_id", "text_id", "text", "anchors").distinct()
        rows = runtime.written(given.mapInArrow(_window_rows(min_words, k), "a long, b long, doc_id long, text_id long, start long"), "windows")
        shared = rows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        hot_windows = rows.join(shared, ["a", "b"]).select("doc_id", "text_id", "start", (F.col("start") + 1).alias("stop"), (F.col("doc_id") > F.col("least")).alias("cut"))
        windows = windows.unionByName(hot_windows)
    per_text = windows.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "stop", "cut")).alias("rows"))
    return per_text.mapInArrow(_range_rows(min_words), "doc_id long, text_id long, start_word long, end_word long, first_copy boolean")


def cut_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the words of their later copies (``first_copy`` false); white space around a cut becomes one blank."""
    doc, name, ranges = (runtime.fresh(c, docs) for c in ("_doc", "_text", "_cuts"))
    cuts = passages.where(~F.col("first_copy")).groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(name)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(ranges))
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist()):
                if text is not None and cuts:
                    _, starts, ends, _, _ = textops.words([text])
                    pieces, done = [], 0
                    for c in sorted(cuts, key=lambda c: c["start_word"]):
                        a, b = c["start_word"], min(c["end_word"], len(starts))
                        if b <= a:
                            continue
                        pieces.append(text[done : starts[a]].rstrip())
                        done = int(ends[b - 1])
                    pieces.append(text[done:].lstrip() if pieces else text)
                    text = " ".join(p for p in pieces if p)
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    same = (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(name))
    return docs.join(cuts, same, "left").select(*docs.columns, ranges).mapInArrow(run, schema)
