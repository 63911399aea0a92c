import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["linear_scan_topk", "linear_scan_remove"])
def test_stated_rows_ask(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df.itertuples(index=False))
    assert key(got) == key(want) and len(got) == 10 * con.execute("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()[0]
