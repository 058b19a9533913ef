"""Registered queries against their DuckDB spelling on the smallest tables."""

import pytest

from playstat.llm import registry
from tests.llm.conftest import SF, sql_table, table_of


@pytest.mark.parametrize("key", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, key):
    assert table_of(registry.QUERIES[key](spark, SF)) == sql_table(con, registry.ORACLE_SQL[key])


def test_every_number_is_registered():
    import __spark_entry__ as E
    keys = list(E.queries())
    assert [sum(k.startswith(f"op{n}_") for k in keys) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in keys
