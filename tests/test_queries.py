import duckdb
import pytest

from compare import TABLES, normal
from huescope.plans import more_queries, queries  # noqa: F401

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and not got.columns.duplicated().any()
    if name in queries.ORACLE_SQL:
        assert normal(got).equals(normal(con.sql(queries.ORACLE_SQL[name]).df()))


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
