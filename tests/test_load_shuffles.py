"""What a load moves: narrow payments, loan facts without a join of their own, and shuffles that tasks can sort in memory."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.plans import etl
from ledgerline.session import LOAD_PARTITIONS, LOAD_SPLIT, small_splits
from ledgerline.sources import schemas as S
from ledgerline.sources.store import TableStore
from ledgerline.streaming import microbatch as MB

FIRST, SPLIT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"
RUN_TS = "2030-01-01 00:00:00"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _context(spark, *more):
    schema = ("loan_id long, customer_id long, customer_sk long, loan_sk long, customer_segment string, loan_amount decimal(14,2), interest_rate decimal(7,4), "
              "tenure_months int, loan_status string, branch_code string, disbursed_at timestamp_ntz, maturity_date date")
    at = dt.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(1, 5, 50, 10, "sme", None, None, 12, "active", "B", at, at.date()), (2, 5, 50, 20, "sme", None, None, 12, "repaid", "B", None, None)], schema)
    return rows.withColumn("loan_amount", (F.col("loan_id") * 100).cast(S.MONEY)).withColumns(dict(more))


def test_shuffles_of_a_load_start_from_many_partitions(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get(FIRST, None) is None
    try:
        for held, inside in (("8", str(LOAD_PARTITIONS)), (str(2 * LOAD_PARTITIONS), None)):
            spark.conf.set("spark.sql.shuffle.partitions", held)
            with small_splits(spark):
                assert spark.conf.get(FIRST, None) == inside
            assert spark.conf.get(FIRST, None) is None
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set(FIRST, "1000")
        with small_splits(spark):
            assert spark.conf.get(FIRST) == "1000"
        assert spark.conf.get(FIRST) == "1000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
        spark.conf.unset(FIRST)


def test_batches_of_a_stream_are_read_and_shuffled_like_other_loads(spark, tmp_root, monkeypatch):
    seen = []
    monkeypatch.setattr(MB, "load", lambda spark, store, src, *a, **k: seen.append(
        tuple(src["payments"].sparkSession.conf.get(c, None) for c in (SPLIT, FIRST))))
    own = spark.conf.get(SPLIT)
    MB.land(spark.createDataFrame([(1, 1)], "payment_id long, loan_id long"), f"{tmp_root}/landing", "part=0")
    MB.payment_stream(spark, f"{tmp_root}/landing", S.PAYMENTS, TableStore(spark, f"{tmp_root}/wh"), {}, f"{tmp_root}/ckpt").awaitTermination()
    assert seen == [(str(LOAD_SPLIT), str(LOAD_PARTITIONS))]
    assert spark.conf.get(SPLIT) == own and spark.conf.get(FIRST, None) is None


def test_loan_facts_of_a_context_with_totals_need_no_join_by_loan(spark):
    ctx = _context(spark, ("_paid", F.when(F.col("loan_id") == 1, F.lit(30)).cast("decimal(38,2)")), ("_n", F.when(F.col("loan_id") == 1, F.lit(3)).cast("long")))
    rows = etl.fact_loan_rows(spark, {}, ctx, RUN_TS)
    assert "hashpartitioning(loan_id" not in _plan(rows)
    got = {r["loan_id"]: (r["disbursement_date_sk"], r["total_paid"], r["payment_count"], r["outstanding_balance"]) for r in rows.collect()}
    assert got == {1: (20240102, 30, 3, 70), 2: (None, 0, 0, 200)}


def test_a_load_keeps_the_totals_in_its_context(spark):
    from conftest import SF_SMALL
    from ledgerline.plans import warehouse as WH
    held = {}

    def sink(name, df):
        held[name] = df
        return df
    etl.run_load(spark, None, WH.operational(spark, SF_SMALL), RUN_TS, sink)
    assert {"_paid", "_n"} <= set(held["_loan_context"].columns)
    want = {tuple(r) for r in WH.tables(spark, SF_SMALL, "full")["fact_loans"].select("loan_id", "total_paid", "payment_count").collect()}
    assert {tuple(r) for r in held["fact_loans"].select("loan_id", "total_paid", "payment_count").collect()} == want


def test_payments_meet_their_loans_with_keys_and_get_their_stamp_last(spark, monkeypatch):
    pays = spark.createDataFrame([(7, 1, dt.date(2024, 1, 2), "cash"), (8, 1, dt.date(1900, 1, 1), "cash"), (9, 2, dt.date(2024, 1, 3), "unlisted")],
                                 "payment_id long, loan_id long, payment_date date, payment_method string")
    for c in ("amount", "principal_portion", "interest_portion", "penalty_portion"):
        pays = pays.withColumn(c, F.lit(1).cast(S.MONEY))
    seen, dense = [], etl.assign_dense_keys
    monkeypatch.setattr(etl, "assign_dense_keys", lambda df, *a: seen.append(df.columns) or dense(df, *a))
    out = etl.new_fact_payments(None, spark, {"stg_payments": pays}, _context(spark), RUN_TS, key_start=4)
    assert seen == [etl.CANDIDATE_COLS] and out.columns == etl.FACT_PAYMENT_COLS
    cash = 1 + [code for code, _ in S.PAYMENT_METHOD_ROWS].index("cash")
    got = {tuple(r) for r in out.select("payment_sk", "payment_id", "date_sk", "method_sk", F.col("etl_loaded_at").cast("string")).collect()}
    assert got == {(5, 7, 20240102, cash, RUN_TS), (6, 9, 20240103, None, RUN_TS)}
