"""Loads that fail, repeat or lack columns; type-2 history on odd days; vacuum."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.changes import fold_changes, live_state, touch_updated
from ledgerline.operators.runlog import RunLog
from ledgerline.operators.upsert import ConflictingRowsError, scd2
from ledgerline.plans import warehouse as WH
from ledgerline.sources import testdata
from ledgerline.sources.readers import MissingColumnError, conform, read_jdbc
from ledgerline.sources.store import TableStore

from conftest import SF_SMALL


def test_missing_source_column_raises(spark):
    schema = T.StructType().add("a", T.IntegerType()).add("b", T.StringType())
    with pytest.raises(MissingColumnError, match="b"):
        conform(spark.range(2).select(F.col("id").alias("a")), schema)


def test_partitioned_jdbc_read_needs_its_bounds(spark):
    with pytest.raises(ValueError, match="num_partitions"):
        read_jdbc(spark, "t", T.StructType().add("a", T.IntegerType()), {"url": "jdbc:none:x"}, "a", 1, 9)


def test_load_without_a_qualifying_loan_commits(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    none = {**src, "customers": src["customers"].withColumn("is_active", F.lit(False))}
    store = TableStore(spark, f"{tmp_root}/wh")
    m = WH.load(spark, store, none, WH.FIXED_RUN_TS)
    assert m["payments_inserted"] == 0 and m["loans_inserted"] == 0 and store.current_version() == 1


def test_increment_on_facts_without_payments_is_refused(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    store = TableStore(spark, f"{tmp_root}/wh")
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    only = {t: e for t, e in store.manifest().items() if not t.startswith("stg_")}
    store.commit(list(only.values()), 2)
    with pytest.raises(ValueError, match="load whole snapshots first"):
        WH.load(spark, TableStore(spark, f"{tmp_root}/wh"), src, WH.FIXED_RUN_TS, increment=True)


def test_vacuum_keeps_what_the_newest_versions_list(spark, tmp_root):
    store = TableStore(spark, f"{tmp_root}/wh")
    for i in range(4):
        store.write_version({"t": spark.range(i + 1)})
    store.write_table("t", spark.range(9), 5)                       # a failed attempt: written, never committed
    assert store.vacuum(keep=2) == 3
    assert store.read("t").count() == 4 and store.read("t", 3).count() == 3


def history(spark, old, rows, day):
    staged = spark.createDataFrame(rows, "id long, city string")
    return scd2(old, staged, "id", ["city"], "sk", F.lit(day))


def test_type_two_same_day_vanished_and_returned(spark):
    one = history(spark, None, [(1, "a"), (2, "b"), (3, "c")], "2030-01-01")
    two = history(spark, one, [(1, "x"), (3, "c")], "2030-01-01")      # changed and vanished on the day they began
    three = history(spark, two, [(1, "y"), (2, "b"), (3, "c")], "2030-01-05")
    rows = {(r.id, r.city, str(r.effective_date), str(r.expiry_date), r.is_current) for r in three.collect()}
    assert rows == {(1, "x", "2030-01-01", "2030-01-04", False), (1, "y", "2030-01-05", "None", True),
                    (2, "b", "2030-01-01", "2030-01-01", False), (2, "b", "2030-01-05", "None", True),
                    (3, "c", "2030-01-01", "None", True)}
    assert three.where("expiry_date < effective_date").count() == 0
    assert three.select("sk").distinct().count() == three.count()


def test_touch_updated_goes_by_the_match_not_by_nulls(spark):
    old = spark.createDataFrame([(1, None, 5, None), (2, "a", 6, None)], "id long, a string, b int, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, None, 7, None), (2, "a", 6, None), (3, "n", 1, None)], "id long, a string, b int, updated_at timestamp_ntz")
    at = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    got = {r.id: r.updated_at is not None for r in touch_updated(old, new, "id", at).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_change_batches_in_any_order(spark):
    log = [(1, "INSERT", 10, "a"), (2, "UPDATE", 10, "b"), (3, "INSERT", 20, "c"), (4, "DELETE", 20, None), (5, "UPDATE", 10, "d")]
    frames = [spark.createDataFrame([r], "log_id long, operation string, id long, v string") for r in log]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [3, 3, 4, 2, 0, 1, 4]):
        state = None
        for i in order:
            state = fold_changes(state, frames[i], "id", ["v"])
        assert [tuple(r) for r in live_state(state).collect()] == [(10, "d")]


def test_defaults_fill_missing_columns_and_nulls(spark):
    schema = T.StructType().add("a", T.IntegerType()).add("s", T.StringType())
    df = spark.createDataFrame([(1,)], "a int")
    assert [tuple(r) for r in conform(df, schema, {"s": "retail"}).collect()] == [(1, "retail")]


def test_gate_refuses_the_whole_batch(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    sound = src["payments"].where("payment_method IN ('mpesa', 'bank_transfer', 'cash', 'cheque', 'online') OR payment_method IS NULL")
    store = TableStore(spark, f"{tmp_root}/wh")
    with pytest.raises(WH.BatchRejected, match="^1 payments"):
        one = sound.limit(1).withColumn("amount", F.lit(-1).cast(src["payments"].schema["amount"].dataType))
        WH.load(spark, store, {**src, "payments": sound.unionByName(one)}, WH.FIXED_RUN_TS, gate=True)
    assert store.current_version() == 0
    assert WH.load(spark, store, {**src, "payments": sound}, WH.FIXED_RUN_TS, gate=True)["version"] == 1


def test_payments_that_differ_refuse_the_run_and_equal_ones_count_once(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    pays = src["payments"]
    one = pays.orderBy("payment_id").limit(1)
    other = one.withColumn("amount", (F.col("amount") + 1).cast(pays.schema["amount"].dataType))
    for increment in (False, True):
        store = TableStore(spark, f"{tmp_root}/wh{increment}")
        with pytest.raises(ConflictingRowsError, match="1 keys"):
            WH.load(spark, store, {**src, "payments": pays.unionByName(other)}, WH.FIXED_RUN_TS, increment=increment)
        assert store.current_version() == 0
        WH.load(spark, store, {**src, "payments": pays.unionByName(one)}, WH.FIXED_RUN_TS, increment=increment)
        assert store.read("src_payments" if increment else "stg_payments").count() == pays.count()
        assert [r.status for r in RunLog(spark, store.root).runs().orderBy("run_id").collect()] == ["failed", "success"]
