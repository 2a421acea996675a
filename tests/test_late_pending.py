"""Payments that the first run could not load."""

from pyspark.sql import functions as F

from ledgerline.plans import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pending_payments_meet_both_fact_tables_by_payment_before_their_loans(spark):
    pays = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (None, 10)], "payment_id long, loan_id long").withColumn("payment_date", F.lit("2024-01-02").cast("date"))
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "payment_id long")
    at = {1: {"stg_payments": pays, "fact_payments": ids(1), "stg_loans": spark.createDataFrame([(10,), (20,)], "loan_id long")}, 2: {"fact_payments": ids(1, 2, 4)}}

    class Store:
        def read_all(self, version):
            return at[version]
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = V.late_pending(Store())
        assert _plan(out).count("Exchange hashpartitioning(payment_id") == 3          # staged, first run's and second run's ids; none again
        assert {(r[0], r[1], r[3], r[4]) for r in out.collect()} == {(2, 20, True, True), (3, 20, True, False), (4, 30, False, True), (None, 10, True, False)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
