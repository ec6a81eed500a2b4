"""Every query that has SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from harrow.catalog import ORACLE_SQL, QUERIES
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    assert rows, "no rows"
    if name in ORACLE_SQL:
        sql_names, expected = sql_rows(ORACLE_SQL[name], sf)
        assert names == sql_names
        assert rows == expected, f"spark only: {list((rows - expected))[:3]}; sql only: {list((expected - rows))[:3]}"
