"""What a load leaves on disk: shuffles and scratch tables go when they are used up, and rows move only where they must."""

import datetime as dt
import glob
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import upsert as UP
from ledgerline.operators.keys import assign_dense_keys, layouts
from ledgerline.plans import registry as R
from ledgerline.plans import warehouse as WH
from ledgerline.session import RELEASE_SHUFFLES, scratch_path, shuffles_released, to_local_path
from ledgerline.sources import schemas as S
from ledgerline.sources import testdata as TD
from ledgerline.sources.store import TableStore
from ledgerline.streaming import microbatch as MB

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, schema, rows):
    """Rows of a declared type, given by some of its columns."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def _source(spark):
    at = dt.datetime(2024, 1, 2)
    return {
        "customers": _rows(spark, S.CUSTOMERS, [{"customer_id": i, "full_name": f"c{i}", "segment": "sme", "is_active": i != 3} for i in (1, 2, 3)]),
        "loans": _rows(spark, S.LOANS, [{"loan_id": 10 * i, "customer_id": i, "product_id": 1, "amount": Decimal("100.00"), "interest_rate": Decimal("9.5"), "tenure_months": 12,
                                         "status": "active", "outstanding_balance": Decimal("100.00"), "branch_code": "B", "disbursed_at": at} for i in (1, 2, 3)]),
        "payments": _rows(spark, S.PAYMENTS, [{"payment_id": i, "loan_id": loan, "amount": Decimal("7.00"), "principal_portion": Decimal("5.00"), "interest_portion": Decimal("2.00"),
                                               "payment_method": "cash", "payment_date": at.date()} for i, loan in ((1, 10), (2, 20), (3, 30), (4, 10), (5, 40))]),
        "loan_products": TD.loan_products(spark),
    }


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.length())) if f.startswith("shuffle_")}


def _layouts(spark):
    return set(glob.glob(to_local_path(scratch_path(spark, "keys", "*"))))


def test_shuffles_of_the_block_go_when_their_query_ends(spark, tmp_root):
    own, before = spark.conf.get(RELEASE_SHUFFLES, None), _shuffle_files(spark)
    with shuffles_released(spark):
        df = spark.range(10_000).groupBy(F.col("id") % 97).count()
        df.write.parquet(f"{tmp_root}/t")
        assert spark.read.parquet(f"{tmp_root}/t").count() == 97 and df.count() == 97 and len(df.collect()) == 97 == len(df.collect())
    assert spark.conf.get(RELEASE_SHUFFLES, None) == own
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_files(spark) - before == set()


def test_a_load_removes_its_layouts_and_scratch_tables(spark, tmp_root):
    before, store = _layouts(spark), TableStore(spark, f"{tmp_root}/wh")
    src = _source(spark)
    WH.load(spark, store, {**src, "payments": src["payments"].where("payment_id <= 3")}, WH.FIXED_RUN_TS, increment=True)
    WH.load(spark, store, src, WH.SECOND_RUN_TS, increment=True)
    assert _layouts(spark) - before == set()
    assert not glob.glob(f"{tmp_root}/wh/tables/_*/*")
    facts = store.read("fact_payments").select("payment_sk", "payment_id", "loan_sk", F.col("etl_loaded_at").cast("date").cast("string"))
    assert {tuple(r) for r in facts.collect()} == {(1, 1, 1, "2030-01-01"), (2, 2, 2, "2030-01-01"), (3, 4, 1, "2030-01-02")}
    assert {r[0] for r in store.read("pending_payments").select("payment_id").collect()} == {3, 5}
    assert {tuple(r) for r in store.read("fact_loans").select("loan_id", "payment_count").collect()} == {(10, 2), (20, 1)}


def test_a_load_that_fails_removes_its_layouts(spark, tmp_root):
    before, src = _layouts(spark), _source(spark)
    twice = src["payments"].unionByName(src["payments"].withColumn("amount", F.lit(8).cast(S.MONEY)))
    with pytest.raises(UP.ConflictingRowsError):
        WH.load(spark, TableStore(spark, f"{tmp_root}/wh"), {**src, "payments": twice}, WH.FIXED_RUN_TS)
    with pytest.raises(ZeroDivisionError), layouts(spark):
        assign_dense_keys(spark.range(5), ["id"], "sk")
        assert len(_layouts(spark) - before) == 1
        raise ZeroDivisionError
    assert _layouts(spark) - before == set()


def test_layouts_stay_where_nobody_says_that_their_rows_are_written(spark):
    before = _layouts(spark)
    keyed = assign_dense_keys(spark.range(5), ["id"], "sk")
    assert len(_layouts(spark) - before) == 1 and keyed.count() == 5


def test_payments_get_their_keys_from_a_scratch_table(spark, tmp_root, monkeypatch):
    from ledgerline.plans import etl
    seen, dense = [], etl.assign_dense_keys
    monkeypatch.setattr(etl, "assign_dense_keys", lambda df, keys, sk, *a: seen.append((sk, _plan(df), df.inputFiles())) or dense(df, keys, sk, *a))
    WH.load(spark, TableStore(spark, f"{tmp_root}/wh"), _source(spark), WH.FIXED_RUN_TS)
    ((plan, files),) = [x for sk, *x in seen if sk == "payment_sk"]
    assert "Exchange" not in plan and files and all("/_payment_candidates/" in f for f in files)


def test_rows_that_are_known_are_not_moved_to_be_dropped(spark, monkeypatch):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, s string")
    staged = spark.createDataFrame([(1, "x"), (3, "c"), (None, "m"), (2, "y")], "id long, s string")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (UP.MOST_REPEATED, -10):                # few new keys; surely too many
            monkeypatch.setattr(UP, "MOST_REPEATED", most)
            nxt, new = UP.insert_absent(old, staged, "id")
            assert {tuple(r) for r in new.collect()} == {(3, "c"), (None, "m")} and nxt.count() == 5
        monkeypatch.undo()
        none = UP.insert_absent(old, staged.where("id IN (1, 2)"), "id")[1]
        assert none.isEmpty() and "Exchange" not in _plan(none)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def test_rows_of_a_key_are_counted_without_moving_single_rows(spark):
    class Store:
        def __init__(self, *rows):
            self.rows = spark.createDataFrame(rows, "k long, v string")

        def read(self, table):
            return self.rows
    single = R._facts(Store((1, "a"), (2, "b")), "t", "k", "k, v")
    assert "Exchange" not in _plan(single) and single.dtypes == [("k", "bigint"), ("v", "string"), ("rows_of_key", "bigint")]
    assert {tuple(r) for r in single.collect()} == {(1, "a", 1), (2, "b", 1)}
    assert {tuple(r) for r in R._facts(Store((1, "a"), (None, "b")), "t", "k", "k, v").collect()} == {(1, "a", 1)}
    shared = R._facts(Store((1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")), "t", "k", "v, k")
    assert {tuple(r) for r in shared.collect()} == {("a", 1, 2), ("b", 1, 2), ("c", 2, 1)}


def test_rows_land_compressed_like_the_tables(spark, tmp_root):
    MB.land(spark.range(3).coalesce(1), f"{tmp_root}/landing", "part=0")
    assert glob.glob(f"{tmp_root}/landing/part=0/*.zstd.parquet") and spark.read.parquet(f"{tmp_root}/landing").count() == 3


def test_source_tables_are_written_with_shuffles_released(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(WH, "_CACHE", {})
    monkeypatch.setattr(TableStore, "write_version", lambda self, tables: seen.append(spark.conf.get(RELEASE_SHUFFLES)))
    monkeypatch.setattr(TableStore, "read_all", lambda self: {})
    WH.operational(spark, SF_SMALL)
    assert seen == ["true"]


def test_an_increment_after_snapshots_looks_for_waiting_payments_once(spark, tmp_root, monkeypatch):
    store, src, plans = TableStore(spark, f"{tmp_root}/wh"), _source(spark), {}
    WH.load(spark, store, {**src, "payments": src["payments"].where("payment_id <= 3")}, WH.FIXED_RUN_TS)
    write = store.write_table
    monkeypatch.setattr(store, "write_table", lambda name, df, *a, **k: plans.update({name: _plan(df)}) or write(name, df, *a, **k))
    late = src["customers"].withColumn("is_active", F.lit(True))             # payment 3 waits for its customer, 5 for its loan
    WH.load(spark, store, {**src, "customers": late, "payments": src["payments"].where("payment_id > 3")}, WH.SECOND_RUN_TS, increment=True)
    assert plans["pending_payments"].count("LeftAnti") == 2                  # against the new facts, for new rows and for waiting ones
    assert not glob.glob(f"{tmp_root}/wh/tables/_*/*")
    assert {r[0] for r in store.read("pending_payments").select("payment_id").collect()} == {5}
    assert {r[0] for r in store.read("fact_payments").select("payment_id").collect()} == {1, 2, 3, 4}
