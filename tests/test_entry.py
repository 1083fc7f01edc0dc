import duckdb
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
OWN = sorted(n for n in e.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_every_query_runs_and_agrees_with_its_sql(spark, sql, name):
    got = e.queries()[name](spark, DATA).toPandas()
    if name in e.oracle_sql():
        want = sql.execute(e.oracle_sql()[name]).df()
        flat = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and flat(got) == flat(want)


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry(spark):
    rows = e.entry(spark)
    assert rows.columns == ["query_id", "doc_id", "score", "rank"] and rows.count() == 50
