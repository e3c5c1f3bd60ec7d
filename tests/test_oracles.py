"""Every core query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from spanloom import kernel_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(plain.where(plain.notna(), None).itertuples(index=False, name=None), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    made = queries.QUERIES[name](spark, SF).toPandas()
    wanted = duck.sql(queries.ORACLES[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)
    assert rows(made, columns) == rows(wanted, columns)
