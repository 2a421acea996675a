"""A batch that holds a key twice is refused before its rows move or are written."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.operators import upsert as UP
from ledgerline.operators.runlog import RunLog
from ledgerline.plans import warehouse as WH
from ledgerline.sources.store import TableStore


def test_a_repeated_key_is_refused_where_it_is_found(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "id long, s string")
    with pytest.raises(UP.DuplicateKeyError, match="t: the batch"):
        UP.with_dup_count(rows, "id", "t")
    assert sorted(r["_dup"] for r in UP.with_dup_count(rows, "id").collect()) == [1, 2, 2]
    assert [r["_dup"] for r in UP.with_dup_count(rows.distinct(), "id", "t").collect()] == [1, 1]


def test_a_load_of_doubled_loans_stages_them_and_writes_no_dimension_of_them(spark, tmp_root):
    src, store = WH.operational(spark, SF_SMALL), TableStore(spark, f"{tmp_root}/wh")
    twice = {**src, "loans": src["loans"].unionByName(src["loans"].where("loan_id % 2 = 0"))}
    with pytest.raises(UP.DuplicateKeyError, match="dim_loan"):
        WH.load(spark, store, twice, WH.FIXED_RUN_TS)
    held = os.listdir(f"{tmp_root}/wh/tables")
    assert {"stg_customers", "stg_loans", "stg_payments"} <= set(held) and "dim_loan" not in held
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    runs = RunLog(spark, store.root).runs().orderBy("run_id").select("status", F.col("error_message").isNotNull()).collect()
    assert [tuple(r) for r in runs] == [("failed", True), ("success", False)]
    assert store.read("dim_loan").count() == src["loans"].count()
