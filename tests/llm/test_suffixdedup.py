import random

import numpy as np
import pytest

from glossa.llm import suffixdedup as S


def test_transform_finds_every_shared_window():
    rnd = random.Random(3)
    for _ in range(200):
        least = rnd.choice([1, 2, 3, 5])
        segments = [np.array([rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 30))], np.uint64) for _ in range(rnd.randint(1, 8))]
        docs = np.array([rnd.randint(0, 4) for _ in segments])
        places = {}
        for i, s in enumerate(segments):
            for j in range(len(s) - least + 1):
                places.setdefault(s[j : j + least].tobytes(), []).append((i, j))
        wanted = sorted((i, j, bool(docs[i] != min(docs[x] for x, _ in v))) for v in places.values() if len({docs[x] for x, _ in v}) > 1 for i, j in v)
        assert sorted(zip(*(x.tolist() for x in S.repeated_windows(segments, docs, least)))) == wanted


def test_prefix_lengths():
    rnd = random.Random(4)
    for _ in range(50):
        words = [rnd.randint(2, 4) for _ in range(rnd.randint(1, 60))]
        symbols, least = np.array([*words, 0]), rnd.choice([1, 2, 4, 8])
        order = S.suffix_order(symbols, max(least, 64))
        lcp = S.shared_prefixes(symbols, order, least)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        for i in range(1, len(symbols)):
            a, b = symbols[order[i - 1] :], symbols[order[i] :]
            n = next(j for j in range(len(symbols)) if a[j : j + 1].tolist() != b[j : j + 1].tolist())
            assert lcp[i] == (n if n < least else -1)


def brute(rows, least):
    places = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            if d is not None:
                places.setdefault(tuple(w[i : i + least]), set()).add((d, i))
    starts = {}
    for v in places.values():
        ids = {d for d, _ in v}
        if len(ids) > 1:
            for d, i in v:
                starts.setdefault((d, d == min(ids)), set()).add(i)
    out = []
    for (d, first), s in starts.items():
        begin = end = None
        for i in sorted(s):
            if begin is not None and i <= end:
                end = i + least
                continue
            if begin is not None:
                out.append((d, begin, end, first))
            begin, end = i, i + least
        out.append((d, begin, end, first))
    return sorted(out)


def ranges(found):
    return sorted((r.doc_id, r.start_word, r.end_word, r.first_copy) for r in found.collect())


@pytest.mark.parametrize("seed, hot, owner", [(1, S.HOT_DOCS, S.OWNER_DOCS), (2, 5, 4), (3, 1, 1)])
def test_spread_search_is_exact(spark, monkeypatch, seed, hot, owner):
    """Also with hot anchors compared by windows and owners in parts."""
    monkeypatch.setattr(S, "HOT_DOCS", hot)
    monkeypatch.setattr(S, "OWNER_DOCS", owner)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    passages = [rnd.choices(words, k=rnd.randint(5, 40)) for _ in range(6)]
    rows = [(None, "a b c"), (1000, None), (1001, ""), (1002, "  \n ")]
    for d in range(60):
        text = rnd.choices(words, k=rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(text))
            text[at:at] = rnd.choice(passages)
        rows.append((d, " ".join(text)))
    rows += [rows[10], rows[11], (500, rows[12][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'o' AS owner")
    assert ranges(S.repeated_passages(docs, 8, 3)) == brute(rows, 8)


def test_cut(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(1, f"alpha {shared} omega"), (2, f"beta\n{shared}\ngamma"), (3, None), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.repeated_passages(docs, 10, 4)
    out = {r.doc_id: r.text for r in S.cut_repeats(docs, found).collect()}
    assert out == {1: rows[0][1], 2: "beta gamma", 3: None, 4: "alone"}


def test_cut_of_one_id_with_several_texts(spark):
    """Each text loses its own words only; equal rows, null ids, very long texts and other columns pass through."""
    p, q = (" ".join(f"{c}{i}" for i in range(12)) for c in "pq")
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, p), (2, p + " x"), (2, q), (2, p + " x"), (None, p), (3, long), (4, f"{long} end"), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, start_word string")
    out = S.cut_repeats(docs, S.repeated_passages(docs, 10, 4))
    assert out.columns == docs.columns
    want = [(1, p), (2, "x"), (2, q), (2, "x"), (None, p), (3, long), (4, "end"), (5, None), (6, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    none = docs.limit(0)
    assert S.cut_repeats(none, S.repeated_passages(none)).count() == 0
    clash = S.cut_repeats(docs.selectExpr("*", "1 AS _cuts", "2 AS _doc", "3 AS _text"), S.repeated_passages(docs, 10, 4))
    assert clash.columns[-3:] == ["_cuts", "_doc", "_text"] and {tuple(r)[-3:] for r in clash.collect()} == {(1, 2, 3)}


def test_one_passage_in_thousands_of_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_DOCS", 500)
    rnd = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(d, f"a{d} b{d} {shared} c{d} {rnd.random()}") for d in range(5000)]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ranges(found) == [(d, 2, 62, d == 0) for d in range(5000)]


def test_long_text_and_empty_table(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "x " + long), (3, "y" * 200_000)], "doc_id long, text string")
    assert ranges(S.repeated_passages(docs)) == [(1, 0, 60_000, True), (2, 1, 60_001, False)]
    assert S.repeated_passages(docs.limit(0)).count() == 0
