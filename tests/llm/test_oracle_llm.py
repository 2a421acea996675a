"""Registered queries of the subpackage against their DuckDB SQL, and those without SQL for their contract."""

import duckdb
import pytest

from conftest import SF_SMALL
from ledgerline.llm.oracle import ORACLE
from ledgerline.llm.queries import QUERIES, queries
from test_oracle import TABLES, _rows


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = _rows(queries()[name](spark, SF_SMALL).toPandas()), _rows(con.sql(ORACLE[name]).to_arrow_table().to_pandas())
    assert got[0] == want[0]
    assert got[1] == want[1]
