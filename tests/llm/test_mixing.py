import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import mixing as M


@given(st.dictionaries(st.integers(0, 20), st.tuples(st.integers(0, 1000), st.just(0.0) | st.floats(0.01, 10)), min_size=1), st.floats(0, 10_000), st.floats(0.1, 8))
@settings(max_examples=300, deadline=None)
def test_water_filling(sources, budget, epochs):
    sizes, weights = {k: v[0] for k, v in sources.items()}, {k: v[1] for k, v in sources.items()}
    share = M.water_fill(sizes, weights, budget, epochs)
    usable = [s for s in sizes if sizes[s] and weights[s]]
    assert all(-1e-9 <= share[s] <= epochs * sizes[s] * (1 + 1e-9) for s in sizes)
    most = min(budget, sum(epochs * sizes[s] for s in usable))
    assert sum(share.values()) == pytest.approx(most, rel=1e-6, abs=1e-6)
    # the sources below their cap have one level in common, and no capped source is below it
    levels = [share[s] / weights[s] for s in usable if share[s] < epochs * sizes[s] * (1 - 1e-9)]
    if levels:
        assert max(levels) == pytest.approx(min(levels), rel=1e-6, abs=1e-9)
        assert all(share[s] / weights[s] <= max(levels) * (1 + 1e-6) + 1e-9 for s in usable)


def test_the_query_clamps_in_several_rounds():
    """Weights of the registered query over sources of like sizes: the cap binds, and binds again after the excess is shared."""
    sizes = {f"src{i}": 1000 + i for i in range(20)} | {None: 900}
    weights = M.stepped_weights(sizes)
    share = M.water_fill(sizes, weights, sum(sizes.values()))
    first = {s for s in sizes if weights[s] * sum(sizes.values()) / sum(weights.values()) > M.MAX_EPOCHS * sizes[s]}
    full = {s for s in sizes if share[s] == M.MAX_EPOCHS * sizes[s]}
    assert first and first < full and any(1 < share[s] / sizes[s] < M.MAX_EPOCHS for s in sizes) and any(share[s] < sizes[s] for s in sizes)


def test_copies_against_brute_force(spark):
    rows = [(i, "t" * (1 + i % 5), ["big", "mid", "tiny", None][0 if i < 600 else 1 if i < 800 else 2 if i < 803 else 3]) for i in range(820)]
    rows += [(900, None, "mid"), (901, "", "mid"), (902, None, "void"), (3, "tttt", "big"), (None, "x", "mid")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n int")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t or "")
    for weights, epochs in ((None, 4.0), ({"big": 1.0, "mid": 2.0, "tiny": 50.0}, 3.0)):
        share = M.water_fill(sizes, weights or dict.fromkeys(sizes, 1.0), sum(sizes.values()), epochs)
        want = []
        for d, t, s in rows:
            parts = round(share[s] / sizes[s] * (1 << 20)) if sizes[s] else 0
            x = int(hashlib.md5(f"{M.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
            want += [(d or -1, t or "", s or "", c + 1) for c in range((parts >> 20) + (x < (parts & 0xFFFFF) << 12))]
        got = M.mix(docs, weights, epochs).collect()
        assert sorted((r.doc_id or -1, r.text or "", r.source or "", r.copy_no) for r in got) == sorted(want)
    assert M.mix(docs, {"tiny": 1.0}).select("source").distinct().collect()[0][0] == "tiny"


def test_shares_are_met_and_edges(spark):
    rows = [(i, "t" * 10, "a" if i < 4000 else "b") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r["source"]: r["count"] for r in M.mix(docs, {"a": 1, "b": 1}, 2.0).groupBy("source").count().collect()}
    assert counts["b"] == 2000 and abs(counts["a"] - 3000) < 150
    assert M.mix(docs.limit(0)).count() == 0
    clash = M.mix(docs.selectExpr("*", "7 AS copy_no", "8 AS _n", "9 AS _source"))
    assert clash.columns == ["doc_id", "text", "source", "_n", "_source", "copy_no"] and {r.copy_no for r in clash.collect()} <= {1, 2, 3, 4}
