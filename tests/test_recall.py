import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def recall(spark, name, gone=()):
    """The share of the true neighbours, the query itself left out, that a query of the embeddings finds."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    near[:, [r.label in gone for r in rows]] = -np.inf
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 50 == 0) for j in np.argsort(-near[i])[:9]}
    got = {(r.query_id, r.id) for r in entry.queries()[name](spark, SF).select("query_id", "id").collect()}
    return len(want & got) / len(want)


@pytest.mark.parametrize("name", ["lsh_classic_candidates", "lsh_classic_search_exact", "lsh_forest_candidates", "lsh_forest_search"])
def test_recall_of_buckets(spark, name):
    assert recall(spark, name) >= 0.9


def test_recall_after_removal(spark):
    assert recall(spark, "lsh_remove", {3}) >= 0.9
