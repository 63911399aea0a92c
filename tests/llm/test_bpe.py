import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import bpe

RANKS = bpe.read_ranks()
SMALL = {bytes([i]): i for i in range(256)} | {b: 256 + i for i, b in enumerate([b"ab", b"bc", b"abc", b"ca", b"aa", b"aaaa", b"bca", b"abab"])}


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS)


@given(st.text(alphabet="abc", max_size=40).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_prefix_table_is_plain_merging(data):
    model = bpe.Bpe(SMALL)
    table = bpe.PrefixTable(model, data)
    for end in range(len(data) + 1):
        assert table.tokens(end) == model.merge(data[:end])


def test_append_and_replace_equal_a_new_table():
    model, rnd = bpe.Bpe(RANKS), random.Random(5)
    alphabet = [b"the", b"tion", b" ", b"e", b"r", "é".encode(), b"=" * 9, b"aa"]
    table = bpe.PrefixTable(model, b"".join(rnd.choices(alphabet, k=200)))
    for _ in range(40):
        if rnd.random() < 0.5:
            table.append(rnd.choice(alphabet))
        else:
            a = rnd.randrange(len(table.data))
            table.replace(a, min(len(table.data), a + rnd.randrange(6)), rnd.choice([b"", *alphabet]))
        assert table.last == bpe.PrefixTable(model, table.data).last


def test_an_edit_stays_local():
    table = bpe.PrefixTable(bpe.Bpe(RANKS), b"the attention of the nation " * 300)
    assert table.replace(10, 12, b"XY") <= 2 + 2 * table.bpe.longest


def test_texts_equal_the_public_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other, rnd = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={}), random.Random(1)
    texts = ["", "it's we'll 'street '' 's", "a" * 5000, "日本語 text\r\n\t x", "<|endoftext|>"]
    texts += ["".join(rnd.choice("ab'strevlmd  \n\t0١é!　’") for _ in range(rnd.randrange(60))) for _ in range(800)]
    ids, first = encoder.encode(texts)
    for t, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == other.encode_ordinary(t)
    assert encoder.decode(ids, first) == [t.encode() for t in texts]


def related():
    """Two unlike words whose polynomials modulo any power of two up to 2**64 are equal."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_related_words(encoder):
    for texts in (related(), related()[::-1]):
        ids, first = encoder.encode([*texts])
        assert encoder.decode(ids, first) == [t.encode() for t in texts]
        for t, a, b in zip(texts, first, first[1:]):
            assert ids[a:b].tolist() == encoder.bpe.merge(t.encode())


def test_pieces_with_one_hash(encoder, monkeypatch):
    """With a hash of three bits nearly all pieces collide, within a group, across groups and with the memo."""
    rnd, right = random.Random(2), bpe.textops.run_hash
    texts = ["".join(rnd.choice("abst  \n0١é!") for _ in range(rnd.randrange(40))) for _ in range(300)] + [*related()]
    want = encoder.encode(texts)
    monkeypatch.setattr(bpe.textops, "run_hash", lambda *a: right(*a) & 7)
    monkeypatch.setattr(bpe.textops, "CHUNK", 256)
    weak = bpe.Encoder(RANKS)
    for some in (texts[:100], texts[100:], texts):
        weak.encode(some)
    got = weak.encode(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_memo_starts_anew(encoder, monkeypatch):
    before = encoder.encode(["one two three"])[0].tolist()
    monkeypatch.setattr(bpe, "MEMO_PIECES", 1)
    assert encoder.encode(["one two three"])[0].tolist() == before and encoder.encode(["four"])[0].size


def test_a_worker_at_rest_holds_little(spark, monkeypatch):
    """Of a task's many pieces few stay in the worker, and with them as without, texts are encoded alike."""
    tasks, docs = [], spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run))
    monkeypatch.setattr(bpe, "KEPT_PIECES", 1000, raising=False)
    monkeypatch.setattr(bpe, "_encoders", {})
    bpe.encode(docs)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(1500)]

    def run():
        rows = [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]
        return [r for b in tasks[0](iter(rows)) for r in b.to_pylist()]

    def held():
        (encoder,) = bpe._encoders.values()
        return sum(a.nbytes for a in vars(encoder).values() if isinstance(a, np.ndarray))

    first = run()
    assert 0 < held() < 200_000
    assert run() == first and held() < 200_000
    model = bpe.Bpe(RANKS)
    assert [r["doc_id"] for r in first] == [*range(1500)] and all(r["round_trip"] and model.decode(r["tokens"]).decode() == texts[r["doc_id"]] for r in first)


def test_pieces_with_one_hash_at_rest(encoder, monkeypatch):
    """What stays at rest is still told by its characters, where pieces collide and where the longest ones do not fit."""
    rnd, right = random.Random(6), bpe.textops.run_hash
    texts = ["".join(rnd.choice("abst  \n0١é!") for _ in range(rnd.randrange(40))) for _ in range(300)]
    want = encoder.encode(texts)
    monkeypatch.setattr(bpe.textops, "run_hash", lambda *a: right(*a) & 63)
    weak = bpe.Encoder(RANKS)
    for pieces, points in ((20, 1 << 20), (1 << 20, 30), (0, 0)):
        monkeypatch.setattr(bpe, "KEPT_PIECES", pieces, raising=False)
        monkeypatch.setattr(bpe, "KEPT_POINTS", points, raising=False)
        weak.encode(texts[::-1])
        weak.rest()
        assert len(weak.keys) <= pieces and len(weak.points) <= points
        got = weak.encode(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_tables(spark):
    rows = [(1, "the end", "x"), (1, "the end", "x"), (2, None, None), (None, "", "y"), (3, "w" * 50_000 + " é\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = bpe.encode(docs, keep=("doc_id", "n")).collect()
    assert len(out) == 5 and all(r.round_trip and r.n_tokens == len(r.tokens) for r in out)
    assert sorted(r.n_tokens for r in out)[:2] == [0, 0]
    back = bpe.decode(bpe.encode(docs, keep=("doc_id", "n")), keep=("doc_id", "n")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("n", "tokens"), keep=("doc_id", "tokens"))
