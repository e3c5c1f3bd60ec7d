"""The recorded corpus: every branch of the kernels against stated rows."""

import duckdb
import pytest
import recorded_cases
from test_oracles import rows


@pytest.mark.parametrize("name", sorted(recorded_cases.QUERIES))
def test_case(spark, name):
    made = recorded_cases.QUERIES[name](spark, None).toPandas()
    wanted = duckdb.sql(recorded_cases.ORACLES[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)
    assert rows(made, columns) == rows(wanted, columns)
