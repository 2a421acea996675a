"""Every registered query with an oracle: Spark result == DuckDB result at sf0.001."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.plans import registry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return None if v is None else str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=lambda t: tuple((x is None, x or "") for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    got = _rows(sdf.toPandas())
    want = _rows(con.sql(E.oracle_sql()[name]).to_arrow_table().to_pandas())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_runs(spark):
    assert set(registry.queries()) <= set(E.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert E.queries()["freshness"](spark, SF_SMALL).count() == 5


def test_every_rule_finds_the_faults(spark):
    for name in registry.queries():
        if name.endswith("_faults"):
            assert all(r.violations > 0 for r in registry.queries()[name](spark, SF_SMALL).collect()), name


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields][:3] == ["year", "month", "month_name"]
