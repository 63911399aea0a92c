import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import topk


def brute(rows, k):
    out = []
    for i, v in rows:
        best = {}
        for j, w in rows:
            if j != i and len(w) == len(v):
                s = round(float(np.dot(v, w)), topk.DIGITS) + 0.0
                best[j] = max(best.get(j, -np.inf), s)
        for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((i, r, j, s))
    return sorted(out)


def searched(rows, k, block):
    rows = sorted(rows, key=lambda r: -float(np.linalg.norm(r[1])))
    buckets = []
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        v = np.array([r[1] for r in part], np.float64)
        buckets.append(topk.Bucket(v.shape[1], float(np.linalg.norm(v[0])), np.array([r[0] for r in part]).tobytes(), v.tobytes()))
    out, used = [], 0
    for q in buckets:
        s = topk.Search(q, k)
        for b in buckets:
            s.visit(b)
        used += s.by_coordinates
        out += list(zip(q.ids[s.row].tolist(), s.rank.tolist() if len(s.row) else [], s.id.tolist(), s.score.tolist()))
    return sorted(out), used


@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 4), st.integers(1, 5), st.booleans())
@settings(max_examples=150, deadline=None)
def test_search_is_exact(seed, n, dim, k, repeats):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * rng.choice([0.0, 0.01, 1.0, 30.0], size=(n, 1))
    if repeats:
        v = np.round(v)
    ids = rng.integers(0, max(2, n - 2), n) if repeats else np.arange(n)
    rows = list(zip(ids.tolist(), v))
    assert searched(rows, k, 7)[0] == brute(rows, k)


def test_coordinates_are_used_and_exact():
    rng = np.random.default_rng(1)
    centres = np.eye(40)
    v = centres[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 40)) * 0.001
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = list(enumerate(v))
    found, used = searched(rows, 3, 400)
    assert used > 0 and found == brute(rows, 3)


def test_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [3.0]), (8, [2.0]), (9, []), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "1 AS rank")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted((r.vec_id, r.rank, r.neighbor_id, r.score) for r in topk.top_k(df, 2).collect())
    assert got == brute(good, 2)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df, 0).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_spread(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, (300, 1)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)
    got = sorted((r.vec_id, r.rank, r.neighbor_id, r.score) for r in topk.top_k(df, 4).collect())
    assert got == brute([(i, np.array(v)) for i, v in rows], 4)


def test_some_rows_ask(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)) * rng.uniform(0.1, 5, (400, 1)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [r for r in brute([(i, np.array(v)) for i, v in rows], 4) if r[0] % 50 == 0]
    got = topk.top_k(df, 4, queries=df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.vec_id, r.rank, r.neighbor_id, r.score) for r in got) == want
    assert topk.top_k(df, 4, queries=df.limit(0)).count() == 0 and topk.top_k(df.limit(0), 4, queries=df).count() == 0
