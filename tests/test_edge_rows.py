"""Edge rows on top of the seed data (FIXTURES §3): out-of-calendar
payments, an inactive customer with a loan, a payment whose loan arrives
one run later, a NULL attribute overwriting a non-NULL one, a customer
without loans."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerline.plans import warehouse as WH
from ledgerline.sources import schemas as S
from ledgerline.sources.store import TableStore

import seed_fixture


def _payment(spark, pid, loan, amount, day):
    return spark.createDataFrame([(pid, loan, D(amount), D(amount), D("0.00"), None, "cash", None,
                                   dt.date.fromisoformat(day), None, None, None)], S.PAYMENTS)


def test_edge_rows_across_two_runs(spark, tmp_path):
    src = seed_fixture.source_tables(spark)
    cust, loans, pays = src["customers"], src["loans"], src["payments"]
    # customer 16: inactive with a loan; customer 17: active without loans
    extra_c = spark.createDataFrame(
        [(16, "Inactive Person", "inactive@example.test", None, None, None, "Nairobi", "Kenya", "retail", False,
          None, None),
         (17, "No Loans", "noloans@example.test", None, None, None, "Kisumu", "Kenya", "sme", True, None, None)],
        S.CUSTOMERS)
    loan16 = loans.where("loan_id = 1").withColumn("loan_id", F.lit(16).cast("long")) \
        .withColumn("customer_id", F.lit(16).cast("long"))
    loan17 = loans.where("loan_id = 3").withColumn("loan_id", F.lit(17).cast("long"))   # arrives in run 2
    edge_pays = (_payment(spark, 51, 1, "100.00", "2017-12-31")        # before the calendar
                 .unionByName(_payment(spark, 52, 1, "100.00", "2051-01-01"))   # after the calendar
                 .unionByName(_payment(spark, 53, 16, "500.00", "2024-03-01"))  # inactive customer's loan
                 .unionByName(_payment(spark, 54, 17, "900.00", "2024-03-01")))  # loan not extracted yet
    run1 = {**src, "customers": cust.unionByName(extra_c), "loans": loans.unionByName(loan16),
            "payments": pays.unionByName(edge_pays)}
    store = TableStore(spark, str(tmp_path) + "/wh")
    WH.load(spark, store, run1, WH.FIXED_RUN_TS)
    w = store.read_all()
    fp_ids = {r.payment_id for r in w["fact_payments"].select("payment_id").collect()}
    assert fp_ids == set(range(1, 51))                           # all four edge payments held back
    assert w["dim_loan"].where("loan_id = 16").count() == 1       # dim_loan keeps the inactive customer's loan
    assert w["fact_loans"].where("loan_id = 16").count() == 0     # ... the fact does not
    assert w["dim_customer"].where("customer_id = 17").count() == 1
    fl1 = w["fact_loans"].where("loan_id = 1").first()
    # the lateral total counts staged payments, including out-of-calendar ones
    assert (fl1.total_paid, fl1.payment_count) == (D("36200.00"), 7)

    # run 2: loan 17 arrives; customer 1 loses its city (NULL overwrites)
    cust2 = cust.unionByName(extra_c).withColumn(
        "city", F.when(F.col("customer_id") == 1, F.lit(None).cast("string")).otherwise(F.col("city")))
    run2 = {**run1, "customers": cust2, "loans": loans.unionByName(loan16).unionByName(loan17)}
    m2 = WH.load(spark, store, run2, WH.SECOND_RUN_TS)
    w = store.read_all()
    assert m2["payments_inserted"] == 1
    late = w["fact_payments"].where("payment_id = 54").first()
    assert late is not None and late.loan_status == "active"
    assert w["dim_customer"].where("customer_id = 1").first().city is None
    assert w["fact_payments"].count() == 51
