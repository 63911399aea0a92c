import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions.murmur import murmur3, murmur3_udf
from glossa.functions.tokenise import Tokeniser
from glossa.operators.vectorise import CountVectoriser, HashingVectoriser, indexed
from glossa.operators.weighting import Tfidf
from glossa.plans.pipeline import Pipeline
from glossa.sources.corpus import corpus, matrix, to_numpy

_TRAIN = {5: "spoon dish and plate", 2: "the little dog laughed to see such fun", 0: "The quick brown fox jumped over the. Lazy dog", 4: "the cow ran around the dog", 1: "the brown Cat sat on the mat", 3: "laughing cow"}
_TEST = {4: "The little dog laughed to see such fun", 1: "the cat and the fiddle", 5: "The dish ran away with the spoon", 0: "hey diddle diddle", 3: "the quick brown fox jumped over the. Lazy dog", 2: "the cow jumped over the moon"}
TRAIN, TEST = ([t[i] for i in range(6)] for t in (_TRAIN, _TEST))
STOP = "the over on to such see around and".split()
M = np.array([[1, 3, 5, 2], [8, 1, 0, 0], [2, 1, 0, 1], [0, 0, 0, 0], [0, 0, 0, 1], [0, 1, 0, 0]], float)


def test_tokens(spark):
    rows = ["It's 2 CAFÉ-au-lait", None, "", "ΟΔΟΣ İx", "áb"]
    got = [r[1] for r in corpus(spark, *rows).select("doc_id", Tokeniser().tokenise(F.col("text"))).sort("doc_id").collect()]
    assert got == [["it", "s", "café", "au", "lait"], [], [], ["οδοσ", "ix"], ["a", "b"]]
    stop = Tokeniser(["it", "CAFÉ"])
    assert corpus(spark, rows[0]).select(stop.tokenise(F.col("text"))).first()[0] == ["s", "café", "au", "lait"]
    assert corpus(spark, "a1b22").select(Tokeniser(pattern="[0-9]+").tokenise(F.col("text"))).first()[0] == ["1", "22"]


@pytest.mark.parametrize("docs,stop,size", [(TRAIN, (), 26), (TRAIN[:1], (), 8), (TRAIN, STOP, 18)])
def test_vocabulary_sizes(spark, docs, stop, size):
    found = {r.term: r.term_idx for r in CountVectoriser(*stop).fit(corpus(spark, *docs)).vocabulary.collect()}
    assert sorted(found.values()) == list(range(len(found)))
    if not stop:
        assert len(found) == size
    assert list(found) and min(found, key=found.get) == ("the" if not stop else "quick")


def test_counts(spark):
    v = CountVectoriser().fit(corpus(spark, *TRAIN))
    got = {(r.doc_id, r.term_idx): r.value for r in v.transform(corpus(spark, *TEST)).collect()}
    index = {r.term: r.term_idx for r in v.vocabulary.collect()}
    import re

    want = {}
    for d, t in enumerate(TEST):
        for w in re.findall("[a-z]+", t.lower()):
            if w in index:
                want[d, index[w]] = want.get((d, index[w]), 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        CountVectoriser().transform(corpus(spark, "a"))


def test_numbering_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("x"))
    got = indexed(df, "x", "n").collect()
    assert sorted(r.n for r in got) == list(range(5000)) and all(r.x == r.n for r in got)


def test_murmur(spark):
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert murmur3([k.encode() for k in known]).tolist() == list(known.values())
    rows = corpus(spark, *known, None).select(murmur3_udf("text")).collect()
    assert [r[0] for r in rows] == [*known.values(), None]


@pytest.mark.parametrize("n,docs,nonzero", [(260000, TEST, 33), (260000, TEST[:3], 11), (260001, TEST, 33)])
def test_hashing(spark, n, docs, nonzero):
    out = HashingVectoriser(n).fit_transform(corpus(spark, *docs))
    assert out.count() == nonzero
    rows = sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, HashingVectoriser(n).transform_rows(corpus(spark, *docs, None, "")).collect())) == rows
    assert HashingVectoriser(1).transform(corpus(spark, "a b a")).first()["value"] == 3


def test_idf_and_tfidf(spark, tmp_path):
    m = matrix(spark, M)
    t = Tfidf(n_docs=4, n_terms=6).fit(m)
    idf = {r.term_idx: r.idf for r in t.idf.collect()}
    assert [idf[i] for i in range(6)] == [math.log(5 / (1 + n)) for n in (M != 0).sum(1)]
    got = to_numpy(t.transform(m).select("term_idx", "doc_id", "value"), "term_idx", "doc_id", (6, 4))
    assert np.allclose(got, [[0, 0, 0, 0], [4.087, 0.511, 0, 0], [0.446, 0.223, 0, 0.223], [0, 0, 0, 0], [0, 0, 0, 0.916], [0, 0.916, 0, 0]], atol=1e-3)
    t.save(str(tmp_path / "t"))
    assert sorted(Tfidf.load(spark, str(tmp_path / "t")).idf.collect()) == sorted(t.idf.collect())
    with pytest.raises(ValueError):
        Tfidf.load(spark, str(tmp_path / "none"))
    signed = Tfidf().fit(spark.createDataFrame([(0, 0, -1.0), (1, 0, 2.0), (1, 1, 0.0), (1, 2, 1.0)], "doc_id long, term_idx int, value double"))
    assert {r.term_idx: round(r.idf, 9) for r in signed.idf.collect()} == {0: 0.0, 2: round(math.log(3 / 2), 9)}


def test_idf_counts_empty_documents_and_weighs_unseen_terms(spark, tmp_path):
    docs = corpus(spark, "a b", "a c", "!!!", None)
    vectoriser, weighting = CountVectoriser(), Tfidf()
    Pipeline(vectoriser, weighting).fit(docs)
    terms = {r.term_idx: r.term for r in vectoriser.vocabulary.collect()}
    assert {terms[r.term_idx]: round(r.idf, 9) for r in weighting.idf.collect()} == {"a": round(math.log(5 / 3), 9), "b": round(math.log(5 / 2), 9), "c": round(math.log(5 / 2), 9)}
    assert weighting.documents is None
    hashed, later = Pipeline(HashingVectoriser(1 << 18), Tfidf()), corpus(spark, "a new new")
    got = sorted(r.value for r in hashed.fit(docs).transform(later).collect())
    assert np.allclose(got, [math.log(5 / 3), 2 * math.log(5)])
    hashed.steps[1].save(str(tmp_path / "t"))
    again = Tfidf.load(spark, str(tmp_path / "t")).transform(hashed.steps[0].transform(later))
    assert np.allclose(sorted(r.value for r in again.collect()), got)


def test_fit_transform_is_fit_and_transform(spark):
    docs = corpus(spark, *TEST, None, "")
    one, two = CountVectoriser("the"), CountVectoriser("the")
    got = sorted(map(tuple, one.fit_transform(docs).collect()))
    assert got == sorted(map(tuple, two.fit(docs).transform(docs).collect()))
    assert sorted(one.vocabulary.collect()) == sorted(two.vocabulary.collect())
