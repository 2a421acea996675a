from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import changes as CH
from ledgerline.operators.posting import post_payments
from ledgerline.operators.scan import running_sum


def _tab(spark, rows):
    return spark.createDataFrame(rows, "id int, a string, b int")


def test_diff_then_apply_reproduces_new_version(spark):
    old = _tab(spark, [(1, "x", 1), (2, "y", 2), (3, "z", None)])
    new = _tab(spark, [(1, "x", 1), (2, "y", 5), (4, "w", 4)])
    log = CH.diff(old, new, "id", table_name="t")
    ops = {r.record_id: (r.operation, r.changed_columns) for r in log.collect()}
    assert ops == {2: ("UPDATE", "b"), 3: ("DELETE", None), 4: ("INSERT", None)}
    d = log.where("operation = 'DELETE'").first()
    assert '"b":null' in d.old_values                     # NULL fields kept in images
    typed = (log.withColumn("log_id", F.monotonically_increasing_id())
             .withColumn("img", F.from_json("new_values", "id int, a string, b int"))
             .select(F.col("record_id").alias("id"), "operation", "log_id", "img.a", "img.b"))
    applied = CH.apply_changes(old, typed, "id", ["a", "b"])
    assert sorted(applied.collect()) == sorted(new.collect())


def test_state_as_of_and_update_of_absent_key(spark):
    log = spark.createDataFrame(
        [(1, 7, "INSERT", "2024-01-01 00:00:00", 1.0), (2, 7, "UPDATE", "2024-01-02 00:00:00", 2.0),
         (3, 8, "UPDATE", "2024-01-03 00:00:00", 3.0), (4, 7, "DELETE", "2024-01-04 00:00:00", None)],
        "log_id long, record_id long, operation string, change_time string, value double") \
        .withColumn("change_time", F.col("change_time").cast("timestamp_ntz"))
    at = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    st = {r.record_id: r.value for r in CH.state_as_of(log, at, "record_id", ["value"]).collect()}
    assert st == {7: 2.0, 8: 3.0}                         # UPDATE of an absent key inserts
    end = {r.record_id for r in CH.state_as_of(log, F.lit("2030-01-01").cast("timestamp_ntz"),
                                               "record_id", ["value"]).collect()}
    assert end == {8}


def test_touch_updated(spark):
    old = spark.createDataFrame([(1, "a", "2020-01-01"), (2, "b", "2020-01-01")], "id int, v string, updated_at string")
    new = spark.createDataFrame([(1, "a", "2020-01-01"), (2, "c", "2020-01-01"), (3, "d", None)],
                                "id int, v string, updated_at string")
    out = {r.id: r.updated_at for r in CH.touch_updated(old, new, "id", F.lit("2030-01-01")).collect()}
    assert out == {1: "2020-01-01", 2: "2030-01-01", 3: None}


def test_running_sum_matches_window_with_hot_key(spark):
    df = spark.range(0, 3000).select((F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50))
                                     .alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = running_sum(df, "k", ["o"], "v", "s", num_partitions=6)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_posting_caps_and_splits(spark):
    loans = spark.createDataFrame([(1, Decimal("100.00"), "active"), (2, Decimal("95000.00"), "active")],
                                  "loan_id long, outstanding_balance decimal(14,2), status string")
    batch = spark.createDataFrame(
        [(11, 1, "2024-01-01", Decimal("40.00")), (12, 1, "2024-01-02", Decimal("50.00")),
         (13, 1, "2024-01-03", Decimal("30.00")), (14, 1, "2024-01-04", Decimal("5.00")),
         (21, 2, "2024-01-01", Decimal("7200.00")), (31, 9, "2024-01-01", Decimal("1.00"))],
        "payment_id long, loan_id long, payment_date string, amount decimal(14,2)")
    ok, new_loans, rejects = post_payments(loans, batch)
    applied = {r.payment_id: (r.applied, r.balance_after) for r in ok.collect()}
    assert applied[11] == (Decimal("40.00"), Decimal("60.00"))
    assert applied[13] == (Decimal("10.00"), Decimal("0.00"))
    r21 = ok.where("payment_id = 21").first()
    assert (r21.principal_portion, r21.interest_portion, r21.balance_after) == \
        (Decimal("5400.00"), Decimal("1800.00"), Decimal("87800.00"))
    assert {r.payment_id: r.reason for r in rejects.collect()} == {14: "nothing_to_apply", 31: "unknown_loan"}
    st = {r.loan_id: (r.outstanding_balance, r.status) for r in new_loans.collect()}
    assert st[1] == (Decimal("0.00"), "repaid") and st[2] == (Decimal("87800.00"), "active")


def test_variant_images_keep_null_fields(spark):
    from ledgerline.operators import changes as CH
    from pyspark.sql import types as T
    old = spark.createDataFrame([(1, "a", 1.5, None), (2, "b", None, None)], "id long, s string, m double, t timestamp_ntz")
    new = spark.createDataFrame([(1, None, 2.5, None), (3, "c", None, None)], "id long, s string, m double, t timestamp_ntz")
    log = CH.as_variant(CH.audit_log(old, new, "id", F.lit("2030-01-01").cast("timestamp_ntz"), "x"))
    texts = {r.record_id: r.n for r in log.select("record_id", F.to_json("new_values").alias("n")).collect()}
    assert texts == {1: '{"id":1,"m":2.5,"s":null,"t":null}', 2: None, 3: '{"id":3,"m":null,"s":"c","t":null}'}
    got = CH.state_from_variant(log, F.lit("2030-01-02").cast("timestamp_ntz"), new.schema)
    assert sorted(map(tuple, got.collect())) == [(1, None, 2.5, None), (3, "c", None, None)]
    assert [f.dataType for f in got.schema][:3] == [T.LongType(), T.StringType(), T.DoubleType()]
