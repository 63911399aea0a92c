"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that can end the prefix's BPE encoding: the token t for
which the prefix before t, encoded the same way, ends in a token u such that BPE keeps (u, t) apart. One table of those
last tokens therefore encodes a piece in a single pass, gives the encoding of every prefix, grows by appending without
looking back, and after an edit is recomputed only until it agrees with the old table again (``PrefixTable``).

Texts are first cut into pieces as the vocabulary's pattern has it (contractions, letters, numbers, other signs, each
with one space before it, and white space). Cutting and hashing are numpy passes over code points (``textops``); each
task encodes a distinct piece once and assembles the documents' ids by gathering; pieces are found by hash and told by their
characters. No shuffle; tables stay in the task, and a worker that waits for its next task keeps the first ``KEPT_PIECES`` of them.

Edge cases: null and empty texts have no tokens and count as decoded right; very long texts and very long pieces are
encoded whole, in time linear in their length; repeated documents each keep their row; an empty table gives an empty table;
strings of special tokens are ordinary text. Output columns that clash with kept input columns raise ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import runtime, textops

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO_PIECES, MEMO_POINTS, MEMO_PAIRS = 1 << 20, 1 << 25, 1 << 17
KEPT_PIECES, KEPT_POINTS = 1 << 17, 1 << 21
ENCODE_ROWS = 512
_APOSTROPHE = ord("'")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """A vocabulary of ranked tokens, all 256 bytes among them; a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.sizes = {r: len(b) for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self._splits: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE by repeated merging of the lowest-ranked pair; only ranks under ``below`` where given."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that ``token`` is merged from; twice itself for a token that is not merged."""
        s = self._splits.get(token)
        if s is None:
            parts = self.merge(self.bytes_of[token], token)
            s = self._splits[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return s

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE encodes the bytes of ``a`` and ``b`` as just these two tokens."""
        # Undo the merges on both sides of the border, the latest first; a merge across it that would come before
        # those still undone would have been taken.
        ranks, text, limit = self.ranks, self.bytes_of, 1 << 62
        while True:
            across = ranks.get(text[a] + text[b])
            if across is not None and across < limit:
                return False
            for left in ((True, False) if a > b else (False, True)):
                if left:
                    limit, a = a, self.split(a)[1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.split(b)[0]
                    if b + 1 != limit:
                        break
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token alone."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def extend(self, data: bytes, last: list[int], end: int) -> None:
        """Appends to ``last`` the last tokens of the prefixes of ``data`` up to length ``end``.

        The automaton gives the tokens that end at each byte; one of them is the prefix's last token.
        """
        known, size = self._apart, self.sizes
        begin = max(0, len(last) + 1 - self.longest)
        todo = len(last)
        for at, t in self.automaton.iter(data[begin:end].decode("latin-1")):
            at += begin
            if at < todo:
                continue
            j = at + 1 - size[t]
            if j:
                pair = last[j - 1] << 32 | t
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.apart(last[j - 1], t)
            else:
                ok = self.whole(t)
            if ok:
                last.append(t)
                todo += 1
        if todo < end:
            raise ValueError(f"no token ends at byte {todo + 1}")

    def tokens(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of length ``end`` (all), read from its table."""
        at, out = len(last) if end is None else end, []
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last, len(data))
        return self.tokens(last)

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(self.bytes_of[t] for t in tokens)


class PrefixTable:
    """The last token of every prefix of a growing, editable byte string."""

    def __init__(self, bpe: Bpe, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; nothing before them is looked at again but the last entries of the table."""
        self.data += more
        self.bpe.extend(self.data, self.last, len(self.data))

    def tokens(self, end: int | None = None) -> list[int]:
        return self.bpe.tokens(self.last, end)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes [start, end); returns how many entries were computed.

        An entry depends on the ``longest`` entries before it at most, so once as many in a row after the edit equal the old
        ones, all later ones do.
        """
        tail = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        self.bpe.extend(self.data, self.last, start + len(new))
        base, same, done = start + len(new), 0, 0
        while done < len(tail) and same < self.bpe.longest:
            self.bpe.extend(self.data, self.last, base + done + 1)
            same = same + 1 if self.last[-1] == tail[done] else 0
            done += 1
        self.last += tail[done:]
        return len(new) + done


def pieces(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the joined texts (each ends where the next one starts)."""
    n = len(cps)
    kind = textops.classes()[cps]
    starts, ends = textops.runs(kind, offsets)
    mark = np.zeros(n + 1, bool)
    k = kind[starts]
    own = np.zeros(n + 1, bool)
    own[offsets] = True
    inside = ~own[ends]  # another run of the same document follows
    space = k == textops.SPACE
    before = space & inside
    mark[starts[space]] = True
    mark[ends[before] - 1] = True
    joins = before & (cps[ends - 1] == 32)
    joined = np.append(False, joins[:-1])
    mark[starts[~space & ~joined]] = True
    # 's 't 'm 'd 're 've 'll split off where the apostrophe starts a piece and is alone in its run
    a = np.flatnonzero((k == textops.OTHER) & (ends - starts == 1) & ~joined & inside)
    a = a[cps[starts[a]] == _APOSTROPHE]
    a = a[k[a + 1] == textops.LETTER] if len(a) else a
    if len(a):
        s, e = starts[a + 1], ends[a + 1]
        c0 = cps[s]
        c1 = np.where(e - s > 1, cps[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(c0, [ord(c) for c in "stmd"])
        two = ((c0 == ord("r")) | (c0 == ord("v"))) & (c1 == ord("e")) | (c0 == ord("l")) & (c1 == ord("l"))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        mark[s[hit]] = False
        mark[(s + size)[hit]] = True
    return np.flatnonzero(mark[:n])


def _unlike(a: np.ndarray, at: np.ndarray, size: np.ndarray, b: np.ndarray, at_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether each run of ``a`` differs from its run of ``b``."""
    out = size != size_b
    same = np.flatnonzero(~out)
    n = size[same]
    total = np.cumsum(n)
    place = np.arange(int(total[-1]) if len(n) else 0)
    shift = total - n
    differs = a[place + np.repeat(at[same] - shift, n)] != b[place + np.repeat(at_b[same] - shift, n)]
    if differs.any():
        out[same[np.unique(np.searchsorted(total, np.flatnonzero(differs), side="right"))]] = True
    return out


class Encoder:
    """Encodes many texts; remembers the encodings of the distinct pieces met, and starts anew beyond ``MEMO_PIECES``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bpe = Bpe(ranks)
        self._clear()
        order = sorted(self.bpe.bytes_of)
        self.token_bytes = pa.array([self.bpe.bytes_of.get(r, b"") for r in range(order[-1] + 1)], pa.large_binary())

    def _clear(self) -> None:
        # Piece hashes in order and the slot of each: arrays, for a dictionary would take ten times their memory.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        # the code points of each slot's piece: a hash finds a piece, only its code points tell that it is the same
        self.length, self.begin, self.points = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def rest(self) -> None:
        """Keeps the pieces met first, which have most of the frequent ones: a worker without a task holds its memory beside busy ones."""
        n = min(KEPT_PIECES, int(np.searchsorted(self.begin + self.length, KEPT_POINTS, side="right")))
        if n >= len(self.size):
            return
        old = self.slots < n
        self.keys, self.slots = self.keys[old], self.slots[old]
        self.flat, self.points = self.flat[: self.start[n]].copy(), self.points[: self.begin[n]].copy()
        self.size, self.start, self.length, self.begin = (x[:n].copy() for x in (self.size, self.start, self.length, self.begin))

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known keys, whether it is one)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _add(self, new: dict[int, bytes]) -> None:
        """Encodes new pieces in the order of their bytes: a piece begins with the table of what it shares with the last one."""
        bpe, before, last = self.bpe, b"", []
        keys, sizes, flat, texts = [], [], [], []
        for piece, key in sorted((b, k) for k, b in new.items()):
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del last[shared:]
            bpe.extend(piece, last, len(piece))
            before, ids = piece, bpe.tokens(last)
            keys.append(key)
            texts.append(piece.decode("utf-8", "surrogatepass"))
            sizes.append(len(ids))
            flat += ids
        sizes = np.array(sizes, np.int64)
        added = np.array(keys, np.uint64)
        order = np.argsort(added)
        at = np.searchsorted(self.keys, added[order])
        self.keys = np.insert(self.keys, at, added[order])
        self.slots = np.insert(self.slots, at, (len(self.size) + order).astype(np.int32))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.flat = np.append(self.flat, np.array(flat, np.int32))
        length = np.array([len(t) for t in texts], np.int64)
        self.begin = np.append(self.begin, len(self.points) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.points = np.append(self.points, textops.codepoints(texts)[0])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n+1 offsets of the texts in them."""
        if len(self.keys) > MEMO_PIECES or len(self.points) > MEMO_POINTS:
            self._clear()
        if len(self.bpe._apart) > MEMO_PAIRS:
            self.bpe._apart.clear()
        groups, new = [], {}
        for _, group in textops.slices(texts):
            cps, offsets = textops.codepoints(group)
            starts = pieces(cps, offsets)
            ends = np.append(starts[1:], len(cps))
            h = textops.run_hash(textops.prefix_hash(cps), starts, ends)
            keys, at, which = np.unique(h, return_index=True, return_inverse=True)
            odd = _unlike(cps, starts, ends - starts, cps, starts[at][which], (ends - starts)[at][which])
            place, known = self._known(keys)
            slot = self.slots[place[known]]
            mine = np.flatnonzero(known)
            wrong = np.zeros(len(keys), bool)
            wrong[mine] = _unlike(cps, starts[at[mine]], (ends - starts)[at[mine]], self.points, self.begin[slot], self.length[slot])
            unseen = np.flatnonzero(~known)
            joined = "".join(group) if len(unseen) or odd.any() or wrong.any() else ""
            for i, key, a, b in zip(unseen.tolist(), keys[unseen].tolist(), starts[at[unseen]].tolist(), ends[at[unseen]].tolist()):
                piece = joined[a:b].encode("utf-8", "surrogatepass")
                wrong[i] = new.setdefault(key, piece) != piece
            # pieces that only share another one's hash are encoded where they stand
            alone = {i: self.bpe.encode_piece(joined[starts[i] : ends[i]].encode("utf-8", "surrogatepass")) for i in np.flatnonzero(odd | wrong[which]).tolist()}
            groups.append((keys, which.astype(np.int32), np.searchsorted(starts, offsets), alone))
        if new:
            self._add(new)
        ids, firsts, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for keys, which, first, alone in groups:
            own = self.slots[self._known(keys)[0]][which] if len(keys) else np.zeros(0, np.int32)
            size, start, flat = self.size[own], self.start[own], self.flat
            if alone:
                n = np.array([len(x) for x in alone.values()])
                size[list(alone)], start[list(alone)] = n, len(flat) + np.cumsum(n) - n
                flat = np.append(flat, np.array([t for x in alone.values() for t in x], np.int32))
            done = np.append(0, np.cumsum(size))
            ids.append(flat[np.arange(done[-1]) + np.repeat(start - done[:-1], size)])
            firsts.append(done[first[1:]] + total)
            total += int(done[-1])
        return np.concatenate(ids), np.concatenate(firsts)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        taken = self.token_bytes.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        at = ends[first].tolist()
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


_encoders: dict[int, Encoder] = {}


def encoder_for(ranks: dict[bytes, int]) -> Encoder:
    """This process's encoder for a vocabulary; its memo lasts from task to task."""
    key = hash(frozenset(ranks.items()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _kept(docs: DataFrame, keep: list[str], added: list[str]) -> DataFrame:
    if clash := set(keep) & set(added):
        raise ValueError(f"the documents already have columns {sorted(clash)}")
    return docs.select(*keep, *([] if "text" in keep else ["text"]))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """``keep`` columns, ``tokens`` (ids of the whole text), ``n_tokens`` and, if ``check``, ``round_trip``: the ids decode to the text."""
    added = [T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False)]
    added += [T.StructField("round_trip", T.BooleanType(), False)] * check
    source = _kept(docs, list(keep), [f.name for f in added])
    runtime.small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    at, schema = source.columns.index("text"), T.StructType([*(source.schema[c] for c in keep), *added])
    columns = [source.columns.index(c) for c in keep]

    def encoded(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        ids, first = encoder.encode(texts)
        out = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), pa.array(np.diff(first))]
        if check:
            back = encoder.decode(ids, first)
            out.append(pa.array([b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts)], pa.bool_()))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), *out], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks.value)
        for batch in runtime.parts(batches, ENCODE_ROWS):
            yield encoded(encoder, batch)
        batch = None
        encoder.rest()
        runtime.release()

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), column: str = "tokens") -> DataFrame:
    """``keep`` columns and ``text``, the text of the ids; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""
    if "text" in keep:
        raise ValueError("the table already has a column 'text'")
    source = tokens.select(*keep, F.col(column).cast("array<int>").alias("_ids"))
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks.value)
        for batch in batches:
            lists = batch.column(len(keep)).to_pylist()
            first = np.cumsum([0, *(len(x or ()) for x in lists)])
            ids = np.array([i for x in lists for i in x or ()], np.int32)
            back = [None if x is None else b.decode("utf-8", "replace") for x, b in zip(lists, encoder.decode(ids, first))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(back, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
