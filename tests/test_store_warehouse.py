import pytest
from pyspark.sql import functions as F

from ledgerline.plans import warehouse as WH
from ledgerline.plans.etl import run_load
from ledgerline.sources import snapshot as SN
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore
from ledgerline.operators.runlog import RunLog

from conftest import SF_SMALL


def test_failed_run_keeps_previous_version_and_logs_failure(spark, tmp_root):
    store = TableStore(spark, tmp_root + "/wh")
    src = testdata.source_tables(spark, SF_SMALL)
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    assert store.current_version() == 1
    bad = {**src, "loans": src["loans"].unionByName(src["loans"].limit(1))}   # duplicate key in batch
    with pytest.raises(Exception):
        WH.load(spark, store, bad, WH.SECOND_RUN_TS)
    fresh = TableStore(spark, tmp_root + "/wh")
    assert fresh.current_version() == 1
    runs = {r.run_id: r.status for r in RunLog(spark, store.root).runs().collect()}
    assert runs == {1: "success", 2: "failed"}


def test_counts_match_fixture_expectations_and_rerun_is_idempotent(spark, tmp_root):
    store = TableStore(spark, tmp_root + "/wh")
    src = testdata.source_tables(spark, SF_SMALL)
    m1 = WH.load(spark, store, src, WH.FIXED_RUN_TS)
    t = store.read_all()
    assert t["dim_loan"].count() == 1500
    assert t["fact_loans"].count() == 1394
    assert t["fact_payments"].count() == 5572
    assert t["fact_payments"].where(F.col("method_sk").isNull()).count() == 942
    assert t["dim_customer"].count() == 139
    assert m1["payments_inserted"] == 5572 and m1["rows_inserted"] == 5572 + 1394
    m2 = WH.load(spark, store, src, WH.SECOND_RUN_TS)
    assert m2["payments_inserted"] == 0 and m2["loans_inserted"] == 0 and m2["loans_updated"] == 1394
    assert store.read("fact_payments").count() == 5572


def test_lazy_run_equals_materialised_run(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    lazy = run_load(spark, None, src, WH.FIXED_RUN_TS).tables
    store = TableStore(spark, tmp_root + "/wh")
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    mat = store.read_all()
    cols = ["payment_sk", "payment_id", "customer_sk", "loan_sk", "date_sk", "method_sk", "payment_amount"]
    assert lazy["fact_payments"].select(*cols).exceptAll(mat["fact_payments"].select(*cols)).count() == 0


def test_snapshot_roundtrip_and_missing_snapshot(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    root = tmp_root + "/snaps"
    SN.export(spark, src, root, "s1", "operational", "gzip")
    res = {r.table_name: r for r in SN.restore(spark, root, "s1", TableStore(spark, tmp_root + "/r")).collect()}
    assert res["payments"].rows_restored == 6000 and all(r.checksum_match for r in res.values())
    with pytest.raises(SN.SnapshotError):
        SN.restore(spark, root, "nope", TableStore(spark, tmp_root + "/r2"))
    listed = {r.snapshot: r.total_rows for r in SN.list_snapshots(spark, root).collect()}
    assert listed == {"s1": 150 + 5 + 1500 + 6000}


def test_compaction_keeps_rows_and_keys(spark, tmp_root):
    store = TableStore(spark, tmp_root + "/wh")
    src = testdata.source_tables(spark, SF_SMALL)
    WH.load(spark, store, testdata.first_snapshot(src), WH.FIXED_RUN_TS)
    WH.load(spark, store, testdata.second_snapshot(src), WH.SECOND_RUN_TS)
    before = store.read("fact_payments")
    assert "," in store.manifest()["fact_payments"]["path"]
    v = store.compact("fact_payments", ["payment_year"], order_by=["payment_id"])
    after = TableStore(spark, tmp_root + "/wh")
    assert after.current_version() == v and "," not in after.manifest()["fact_payments"]["path"]
    cols = ["payment_sk", "payment_id", "payment_year"]
    assert after.read("fact_payments").select(*cols).exceptAll(before.select(*cols)).count() == 0
    assert after.read("fact_payments").count() == before.count()
    assert after.manifest()["fact_payments"]["max_key"] == store.manifest(v - 1)["fact_payments"]["max_key"]
