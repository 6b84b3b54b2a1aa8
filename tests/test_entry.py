import duckdb
import pytest

import __spark_entry__ as entry
from skarn import more_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings publications persons crawl_records crawls ref_names eval_items mix_targets".split()


def _plain(v):
    return "" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(more_queries.queries()))
def test_rows_equal_the_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    rows = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in expected.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_every_query_has_its_own_name():
    assert not set(more_queries.queries()) & set(queries.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
