import random

import pytest

import corpus_pipeline
from glossa.llm import bpe, mixing

from .test_linededup import brute as lines_kept
from .test_ngramjoin import brute as near
from .test_quality import made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rnd = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    texts, labels = made(5, 360)
    rows = []
    for i, t in enumerate(texts):
        host = f"src{0 if i % 2 else i % 5}"
        lines = [f"Shared menu of {host}"] * (i % 3 > 0) + [t]
        rows.append((i, "\n".join(lines), "en", host, 0))
    for i in range(30):
        w = rows[i][1].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((400 + i, " ".join(w), "en", rows[i][3], 0))
    rows += [(500, None, None, "src1", None), (501, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, {i for i, y in enumerate(labels) if y}, {i for i, y in enumerate(labels) if not y}


def test_stages_against_brute_force(spark, folder):
    path, good, junk = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.runtime.written(stage(spark, docs, path), "test-stage")
        after = docs.collect()
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if number == 0:
            kept = {r.doc_id for r in after}
            assert len(kept & good) >= 0.97 * len(good) and len(kept & junk) <= 0.1 * len(junk)
            assert set(after) <= set(before)
        elif number == 1:
            want = dict(zip([r.doc_id for r in before], lines_kept([(r.text, r.source) for r in before])))
            got = {r.doc_id: r.text for r in after}
            assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}
            assert any("menu" in (r.text or "") for r in before) and after != before
        elif number == 2:
            found = near([(r.doc_id, r.text) for r in before])[0]
            assert sorted(r.doc_id for r in after) == sorted(d for d, c, _ in found if d == c) and len(after) < len(before)
        elif number == 3:
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text or "")
            share = mixing.water_fill(sizes, dict.fromkeys(sizes, 1.0), sum(sizes.values()))
            for source, n in sizes.items():
                got = sum(len(r.text or "") for r in after if r.source == source)
                assert abs(got - share[source]) <= 0.25 * n + 1
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        else:
            encoder = bpe.Encoder(bpe.read_ranks())
            texts = sorted((r.doc_id, r.text or "") for r in before)
            assert all(r.round_trip for r in after)
            assert sorted((r.doc_id, encoder.bpe.decode(r.tokens).decode()) for r in after) == texts
            assert [r.tokens for r in sorted(after, key=lambda r: r.doc_id)][:5] == [encoder.encode([t])[0].tolist() for _, t in texts[:5]]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "lang", "source", "tokens", "n_tokens", "round_trip"] and out.count() > 100


def test_stages_at_the_edges(spark, folder, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names, and an empty table."""
    path = folder[0]
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, "some text of a few words here", "en", "a", 29), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, long + " end", None, "b", None)]
    rows += [(5, "a plain text that is there twice and then once more", "en", "b", 51)] * 2 + [(6, "a plain text that is there twice and then once more", "de", None, 51), (7, "x" * 300_000, "en", "b", 300_000)]
    clash = ["_quality_prob", "quality_prob", "_host", "_drop", "_gone", "_source", "_whole", "_below", "_n", "_copy", "copy_no", "key_a", "sid", "root"]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(clash)))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        got = out.collect()
        assert stage(spark, docs.limit(0), path).count() == 0
        if number < 4:
            assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(clash))) for r in got)
        if number == 1:
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((d, t) for d, t, *_ in rows), key=str)
        elif number == 2:
            assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 5, 5, 7]
        elif number == 4:
            assert len(got) == len(rows) and all(r.round_trip for r in got) and sum(r.n_tokens == 0 for r in got) == 2


def test_run_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
