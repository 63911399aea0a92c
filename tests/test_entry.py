import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_its_removable_part():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['glossa.llm'] = None; import __spark_entry__ as e; assert 'lsi_query' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


@pytest.mark.parametrize("name", ["tfidf_transform", "cosine_distance", "lsh_forest_candidates", "random_indexing"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df.itertuples(index=False))
    assert key(got) == key(want)
