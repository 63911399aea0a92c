import random
import re

import numpy as np
import pytest

from glossa.llm import fingerprint as P


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def signs(f):
    b, x, y = f.split(":")
    short = lambda s: re.sub(r"(.)\1{3,}", r"\1\1\1", s)
    return [(int(b), short(x)), (2 * int(b), short(y))]


def score(f, g):
    best = 0
    for a, x in signs(f):
        for b, y in signs(g):
            if a == b and {x[i : i + 7] for i in range(len(x) - 6)} & {y[i : i + 7] for i in range(len(y) - 6)}:
                n = max(len(x), len(y))
                best = max(best, (100 * n - 100 * levenshtein(x, y)) // n)
    return best


def brute(rows, least):
    """Sorted rows of ``classes`` and the links between unlike fingerprints, by comparing all pairs."""
    nodes = {(d, f) for (d, _), f in zip(rows, P.fingerprints([t for _, t in rows])) if d is not None}
    prints = sorted({f for _, f in nodes if f is not None})
    near = {(f, g): s for i, f in enumerate(prints) for g in prints[i + 1 :] if (s := score(f, g)) >= least}
    ids = {f: [d for d, g in nodes if g == f] for f in prints}
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    count, best = {f: len(ids[f]) - 1 for f in prints}, {f: 100 if len(ids[f]) > 1 else None for f in prints}
    for (f, g), s in near.items():
        parent[root(f)] = root(g)
        for x, y in ((f, g), (g, f)):
            count[x] += len(ids[y])
            best[x] = max(best[x] or 0, s)
    least_id = {r: min(d for f in prints if root(f) == r for d in ids[f]) for r in {root(f) for f in prints}}
    return sorted(((d, f or "", least_id[root(f)], count[f], best[f]) if f is not None else (d, "", d, 0, None) for d, f in nodes), key=str), near


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9)))
    passage, rows = " ".join(word() for _ in range(120)), []
    for d in range(n):
        if rows and rnd.random() < 0.5:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rnd.choice([1, 30, 200, 700]))]
            if rnd.random() < 0.4:
                w += passage.split()
        rows.append((d, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, ""), (None, rows[3][1]), (203, rows[3][1]), (4, rows[4][1]), (204, "x" * 100_000)]


def test_edit_distances():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("ABab/+", k=rnd.choice([0, 1, 5, 30, 63, 64]))) for _ in range(50)]
    codes, size = P._codes(words)
    i, j = (x.ravel() for x in np.indices((50, 50)))
    got = P.edit_distances(i, size[i], P._masks(codes), codes[j], size[j])
    assert got.tolist() == [levenshtein(words[a], words[b]) for a, b in zip(i, j)]


def test_rolling_hash_is_of_seven_bytes():
    data = np.random.default_rng(0).integers(0, 256, 200).astype(np.uint8)
    roll = P.rolling(data)
    for i in range(6, 200):
        w = [int(x) for x in data[i - 6 : i + 1]]
        x = 0
        for c in w:
            x = ((x << 5) & 0xFFFFFFFF) ^ c
        assert roll[i] == (sum(w) + sum((k + 1) * c for k, c in enumerate(w)) + x) % 2**32


def test_boundaries_follow_content():
    rnd = random.Random(2)
    text = "".join(rnd.choices("abcdefgh ", k=6000))
    a, b = P.fingerprints([text, text[:3000] + "inserted" + text[3000:]])
    assert score(a, b) > 80 and score(a, P.fingerprints(["".join(rnd.choices("abcdefgh ", k=6000))])[0]) == 0
    assert P.fingerprints(["", None]) == ["3::", None]
    assert all(len(x) <= 64 for t in ("a" * 10, text, text * 30) for x in P.fingerprints([t])[0].split(":")[1:])


@pytest.mark.parametrize("group, least", [(P.GROUP, P.LEAST_SCORE), (3, 1)])
def test_classes_and_links_against_all_pairs(spark, monkeypatch, group, least):
    monkeypatch.setattr(P, "GROUP", group)
    rows = corpus(group)
    rows += [(4, rows[9][1]), (205, rows[9][1][:-1] + "q"), (206, rows[9][1] + " qq")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, sign string, n int").repartition(3)
    want, near = brute(rows, least)
    got = [(r.doc_id, r.fingerprint or "", r.class_id, r.n_links, r.best_score) for r in P.classes(docs, least).collect()]
    assert sorted(got, key=str) == want
    nodes, links = P.links(docs, least)
    found = links.collect()
    assert {tuple(sorted((r.fingerprint_a, r.fingerprint_b))): r.score for r in found} == near and len(found) == len(near)
    assert {(r.doc_id, r.fingerprint or "") for r in nodes.collect()} == {(r[0], r[1]) for r in want}
    assert P.classes(docs.limit(0), least).count() == 0


def test_a_group_of_copies_is_one(spark):
    rows = corpus(9, 8)
    docs = spark.createDataFrame([(1000 + i, rows[i % 2][1]) for i in range(3000)] + [(i, None) for i in range(3)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.best_score) for r in P.classes(docs).collect())
    alike = score(*P.fingerprints([rows[0][1], rows[1][1]])) >= P.LEAST_SCORE
    assert got == [(i, i, 0, None) for i in range(3)] + [(1000 + i, 1000 + (0 if alike else i % 2), 2999 if alike else 1499, 100) for i in range(3000)]


def test_column_score(spark):
    prints = [f for f in P.fingerprints([t for _, t in corpus(5, 12)]) if f]
    pairs = spark.createDataFrame([(f, g) for f in prints for g in prints], "f string, g string")
    for r in pairs.select("f", "g", P.score(P.signatures(pairs["f"]), P.signatures(pairs["g"])).alias("s")).collect():
        assert r.s == score(r.f, r.g)
