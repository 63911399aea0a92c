import random

import pytest

from glossa.operators import vectorise as V
from glossa.operators.vectorise import CountVectoriser, HashingVectoriser


def corpus(n=60):
    rnd = random.Random(4)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(80)]
    return [(rnd.randrange(10**12), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 300])))) for _ in range(n)] + [(7, None), (8, "!!")]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("tokens", [1, 50, 1 << 20])
def test_counting_in_place_is_counting_by_shuffles(spark, monkeypatch, tokens):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(V, "TOKENS", tokens)
    v, half = CountVectoriser(), docs.where("doc_id % 2 = 0")
    got = [rows(v.fit_transform(docs)), rows(v.vocabulary), rows(CountVectoriser().fit(half).transform(docs)), rows(HashingVectoriser(13).transform(docs))]
    monkeypatch.setattr(V, "once", lambda df: False)
    v = CountVectoriser()
    assert got == [rows(v.fit_transform(docs)), rows(v.vocabulary), rows(CountVectoriser().fit(half).transform(docs)), rows(HashingVectoriser(13).transform(docs))]


def test_ids_that_repeat_add_up(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert not V.once(docs) and V.once(docs.limit(0))
    assert {(r.doc_id, r.value) for r in CountVectoriser().fit_transform(docs).collect()} >= {(1, 3.0), (None, 2.0)}


def test_few_rows_are_shuffled(spark):
    """A group of documents has each term once, whatever number of them have it."""
    docs = spark.createDataFrame([(i, "the same few words " * 3) for i in range(500)], "doc_id long, text string").coalesce(1)
    packed = CountVectoriser()._postings(docs)
    assert packed.count() == 4 and {len(r.docs) for r in packed.collect()} == {500}
