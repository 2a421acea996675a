"""Stored reports equal the views after every kind of commit, and fold only what is new."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import delta as DL
from ledgerline.plans import maintained as M
from ledgerline.plans import views as V
from ledgerline.plans import warehouse as WH
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore

from conftest import SF_SMALL

VIEWS = {"monthly_revenue": V.monthly_revenue, "top_customers": V.top_customers, "status_distribution": V.loan_status_distribution,
         "payment_by_method": V.payment_by_method, "branch_performance": V.branch_performance}


def agree(store):
    w = store.read_all()
    for name, view in VIEWS.items():
        got, want = M.REPORTS[name](store), view(w)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def test_reports_follow_every_commit(spark, tmp_root):
    src = TableStore(spark, f"{tmp_root}/src")
    src.write_version(testdata.source_tables(spark, SF_SMALL))
    src = src.read_all()
    store = TableStore(spark, f"{tmp_root}/wh")
    first = src["payments"].where("payment_id % 3 = 0")
    WH.load(spark, store, {**src, "payments": first}, WH.FIXED_RUN_TS)
    agree(store)                                                            # nothing stored yet: all from the facts
    M.refresh(spark, store)
    agree(store)
    DL.adopt(spark, store)
    months = store.manifest()["sum_month"]["path"]
    # a few payments of one loan, and loans that change branch and status before their next payment
    few = src["payments"].where("payment_id % 3 != 0 AND loan_id % 4 = 0")
    moved = src["loans"].where("loan_id % 8 = 0").withColumn("branch_code", F.lit("BR-000")).withColumn("status", F.lit("defaulted"))
    before = {b: p for b, (p, _) in json.loads(store.manifest()[M.SUPPORT]["layout"])["buckets"].items()}
    one = few.orderBy("loan_id").limit(1)
    DL.load_changes(spark, store, {"payments": one}, WH.SECOND_RUN_TS)
    after = {b: p for b, (p, _) in json.loads(store.manifest()[M.SUPPORT]["layout"])["buckets"].items()}
    assert store.manifest()["sum_month"]["path"] != months and sum(before[b] != after[b] for b in before) <= 1
    agree(store)
    DL.load_changes(spark, store, {"loans": moved, "payments": few}, WH.SECOND_RUN_TS)
    assert store.manifest()[M.SUPPORT]["max_key"] == store.manifest()["fact_payments"]["max_key"]
    agree(store)
    store.compact("fact_payments", ["payment_year"], order_by=["payment_id"])
    version = store.current_version()
    assert M.refresh(spark, store) == version                               # compaction brings nothing new
    agree(store)
    # facts that are not folded yet are added on reading
    store.commit([e for t, e in store.manifest().items() if t not in (*M.SUMS, M.SUPPORT)], version + 1)
    agree(store)


def test_a_store_without_facts_has_no_reports(spark, tmp_root):
    with pytest.raises(ValueError, match="no payment facts"):
        M.refresh(spark, TableStore(spark, f"{tmp_root}/wh"))
