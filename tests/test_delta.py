"""The load of changes: what it reads and rewrites, and that it ends where loads of whole snapshots end."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.upsert import ConflictingRowsError
from ledgerline.plans import delta as DL
from ledgerline.plans import warehouse as WH
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore, bucket_of

from conftest import SF_SMALL

FACT = ["payment_id", "date_sk", "method_sk", "payment_amount", "loan_amount", "customer_segment", "loan_status", "branch_code"]
LOAN = ["loan_id", "principal_amount", "outstanding_balance", "total_paid", "payment_count", "is_active", "customer_segment", "branch_code"]


@pytest.fixture(scope="module")
def src(spark, tmp_path_factory):
    """The source tables, written once, with the full load's facts of them."""
    store = TableStore(spark, str(tmp_path_factory.mktemp("src")))
    store.write_version(testdata.source_tables(spark, SF_SMALL))
    return store.read_all()


@pytest.fixture(scope="module")
def whole(spark, src, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("whole")))
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    return store


def same(store, whole, facts=FACT, loans=LOAN):
    for table, cols in (("fact_payments", facts), ("fact_loans", loans)):
        got, want = store.read(table).select(*cols), whole.read(table).select(*cols)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), table


def paths(store, table):
    return {b: p for b, (p, _) in json.loads(store.manifest()[table]["layout"])["buckets"].items()}


def test_a_small_update_leaves_the_files_of_other_buckets_as_they_were(spark, src, whole, tmp_root):
    store = TableStore(spark, f"{tmp_root}/wh")
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    DL.adopt(spark, store)
    same(store, whole)
    before = {t: paths(store, t) for t in DL.KEYS}
    # one loan in a hundred of one bucket
    one = src["loans"].where(bucket_of("loan_id", 8) == 3).orderBy("loan_id").limit(2).withColumn("branch_code", F.lit("BR-X"))
    m = DL.load_changes(spark, store, {"loans": one}, WH.SECOND_RUN_TS)
    after = {t: paths(store, t) for t in DL.KEYS}
    for t in ("stg_loans", "dim_loan", "fact_loans"):
        assert {b for b in before[t] if before[t][b] != after[t][b]} <= {"3"} and set(before[t]) == set(after[t])
    assert after["stg_loans"]["3"] != before["stg_loans"]["3"]
    for t in ("stg_customers", "dim_customer", "payment_totals", "waiting_payments", "loans_by_holder"):
        assert after[t] == before[t]
    assert m["staged"] == {"loans": 2} and m["payments_inserted"] == 0 and m["buckets"]["dim_loan"] == 1
    changed = store.read("dim_loan").where("branch_code = 'BR-X'")
    assert changed.count() == 2 and store.read("dim_loan").count() == whole.read("dim_loan").count()
    # fact_loans refreshes flags and sums only, as a whole-snapshot load does
    same(store, whole)
    assert store.manifest()["dim_loan"]["row_count"] == store.read("dim_loan").count()


def test_batches_in_any_order_end_where_one_full_load_ends(spark, src, whole, tmp_root):
    store = TableStore(spark, f"{tmp_root}/wh")
    even, odd = src["payments"].where("payment_id % 2 = 0"), src["payments"].where("payment_id % 2 = 1")
    few = src["customers"].where("customer_id % 3 = 0")
    steps = [{"payments": even, "loan_products": src["loan_products"]}, {"loans": src["loans"].where("loan_id % 2 = 0")}, {"customers": few},
             {"customers": src["customers"].where("customer_id % 3 != 0"), "payments": odd},
             {"loans": src["loans"].where("loan_id % 2 = 1"), "payments": even}]          # the even payments come a second time
    for i, changes in enumerate(steps):
        m = DL.load_changes(spark, store, changes, WH.FIXED_RUN_TS, batch_id=i)
        if i < 2:
            assert m["payments_inserted"] == 0
    same(store, whole)
    for t, key in (("fact_payments", "payment_sk"), ("fact_loans", "loan_fact_sk"), ("dim_customer", "customer_sk"), ("dim_loan", "loan_sk")):
        df = store.read(t)
        n = df.count()
        assert (df.select(key).distinct().count(), df.agg(F.max(key)).first()[0]) == (n, n)
    left = store.read("waiting_payments")
    known = src["payments"].count()
    assert left.count() == known - whole.read("fact_payments").count() == left.select("payment_id").distinct().count()
    # nothing new: nothing is loaded, no bucket rewritten but those of rows that came again
    m = DL.load_changes(spark, store, {"payments": even.limit(50)}, WH.FIXED_RUN_TS)
    assert m["payments_inserted"] == 0
    same(store, whole)


def test_a_batch_without_new_parents_reads_no_waiting_row(spark, src, tmp_root, monkeypatch):
    store = TableStore(spark, f"{tmp_root}/wh")
    first = src["payments"].where("payment_id % 10 != 0")
    DL.load_changes(spark, store, {**src, "loans": src["loans"].where("loan_id % 2 = 0"), "payments": first}, WH.FIXED_RUN_TS)
    waiting = store.read("waiting_payments").count()
    assert waiting > 1000
    read = []
    was = TableStore.read_buckets

    def seen(self, entry, only=None):
        read.append((entry["table_name"], only))
        return was(self, entry, only)
    monkeypatch.setattr(TableStore, "read_buckets", seen)
    loaded = store.read("fact_payments").select("loan_id" if "loan_id" in store.read("fact_payments").columns else "loan_sk")
    known = store.read("dim_loan").join(loaded.distinct(), "loan_sk").select("loan_id")
    new = src["payments"].where("payment_id % 10 = 0").join(known, "loan_id", "left_semi")
    read.clear()
    m = DL.load_changes(spark, store, {"payments": new}, WH.SECOND_RUN_TS)
    assert m["payments_inserted"] == new.count() > 0
    assert not [r for r in read if r[0] == "waiting_payments"]
    # the parents of a few: only their buckets are read
    late = src["loans"].where("loan_id % 2 = 1").orderBy("loan_id").limit(1)
    DL.load_changes(spark, store, {"loans": late}, WH.SECOND_RUN_TS)
    assert [len(only) for t, only in read if t == "waiting_payments"] == [1]


def test_changed_holders_bring_all_their_loans(spark, src, tmp_root):
    store, snapshots = TableStore(spark, f"{tmp_root}/wh"), TableStore(spark, f"{tmp_root}/snapshots")
    first = src["payments"].where("payment_id % 2 = 0")
    active = src["customers"].where("is_active")
    ids = [r[0] for r in active.select("customer_id").orderBy("customer_id").limit(6).collect()]
    gone, back, richer = ids[:2], ids[2:4], ids[4:]
    start = src["customers"].withColumn("is_active", F.col("is_active") & ~F.col("customer_id").isin(back))
    second = src["customers"].withColumn("is_active", F.col("is_active") & ~F.col("customer_id").isin(gone)).withColumn(
        "segment", F.when(F.col("customer_id").isin(richer), "corporate").otherwise(F.col("segment")))
    loans = src["loans"].withColumn("customer_id", F.when(F.col("loan_id") % 97 == 0, ids[5]).otherwise(F.col("customer_id")))   # some change hands
    for s in (store, snapshots):
        step = (lambda c, t: DL.load_changes(spark, store, c, t)) if s is store else (lambda c, t: WH.load(spark, snapshots, c, t))
        step({**src, "customers": start, "payments": first}, WH.FIXED_RUN_TS)
        if s is store:
            step({"customers": second.where(F.col("customer_id").isin(ids)), "loans": loans.where("loan_id % 97 = 0"),
                  "payments": src["payments"].where("payment_id % 2 = 1")}, WH.SECOND_RUN_TS)
        else:
            step({**src, "customers": second, "loans": loans}, WH.SECOND_RUN_TS)
    same(store, snapshots)
    dims = [s.read("dim_customer").select("customer_sk", "customer_id", "segment", "is_current") for s in (store, snapshots)]
    assert dims[0].exceptAll(dims[1]).isEmpty() and dims[1].exceptAll(dims[0]).isEmpty()
    holders = store.read("loans_by_holder")
    want = store.read("stg_loans").select("customer_id", "loan_id")
    assert holders.exceptAll(want).isEmpty() and want.exceptAll(holders).isEmpty()


def test_conflicts_deleted_rows_and_mixed_modes(spark, src, tmp_root):
    store = TableStore(spark, f"{tmp_root}/wh")
    two = src["loans"].limit(1).unionByName(src["loans"].limit(1).withColumn("status", F.lit("other")))
    with pytest.raises(ConflictingRowsError):
        DL.load_changes(spark, store, {**src, "loans": two}, WH.FIXED_RUN_TS)
    assert store.current_version() == 0
    DL.load_changes(spark, store, src, WH.FIXED_RUN_TS)
    n, facts = store.read("stg_loans").count(), store.read("fact_loans").count()
    DL.load_changes(spark, store, {"loans": src["loans"].orderBy("loan_id").limit(3).withColumn("_deleted", F.lit(True))}, WH.SECOND_RUN_TS)
    assert store.read("stg_loans").count() == n - 3 == store.read("loans_by_holder").count() and store.read("fact_loans").count() == facts
    with pytest.raises(ValueError, match="loaded by changes"):
        WH.load(spark, store, src, WH.SECOND_RUN_TS, increment=True)
    DL.rebucket(store, "dim_loan", 11)
    assert json.loads(store.manifest()["dim_loan"]["layout"])["count"] == 11 and store.read("dim_loan").count() == n
    WH.load(spark, store, src, WH.SECOND_RUN_TS)                            # back to whole snapshots
    assert "waiting_payments" not in store.manifest() and not store.manifest()["dim_loan"].get("layout")
    with pytest.raises(ValueError, match="adopt"):
        DL.load_changes(spark, store, {"loans": src["loans"].limit(1)}, WH.SECOND_RUN_TS)


def test_vacuum_keeps_the_buckets_that_are_carried_over(spark, src, tmp_root):
    store = TableStore(spark, f"{tmp_root}/wh")
    DL.load_changes(spark, store, src, WH.FIXED_RUN_TS)
    n = store.read("fact_loans").count()
    for i in range(3):
        DL.load_changes(spark, store, {"loans": src["loans"].where(f"loan_id % 300 = {i}")}, WH.SECOND_RUN_TS)
    assert store.vacuum(keep=1) > 0
    again = TableStore(spark, f"{tmp_root}/wh")
    assert again.read("fact_loans").count() == n and again.manifests().select("version").distinct().count() == 1
