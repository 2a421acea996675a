"""Golden results on the source system's own seed rows (FIXTURES §3)."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import views as V
from ledgerline.plans import warehouse as WH
from ledgerline.sources.store import TableStore

import seed_fixture


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    src = seed_fixture.source_tables(spark)
    store = TableStore(spark, str(tmp_path_factory.mktemp("seed")) + "/wh")
    m1 = WH.load(spark, store, src, WH.FIXED_RUN_TS)
    m2 = WH.load(spark, store, src, WH.SECOND_RUN_TS)
    return {"src": src, "w": store.read_all(), "m1": m1, "m2": m2}


def test_first_and_second_run(seed):
    assert seed["m1"]["payments_inserted"] == 50
    assert seed["m1"]["rows_inserted"] == 65 and seed["m1"]["rows_updated"] == 30
    assert seed["m2"]["payments_inserted"] == 0
    fp = seed["w"]["fact_payments"]
    t = fp.agg(F.count(F.lit(1)), F.sum("payment_amount"), F.sum("principal_portion"),
               F.sum("interest_portion")).first()
    assert tuple(t) == (50, D("1370100.00"), D("579500.00"), D("790600.00"))


def test_monthly_revenue(seed):
    rows = {(r.year, r.month): (r.total_revenue, r.total_principal, r.total_interest, r.payment_count)
            for r in V.monthly_revenue(seed["w"]).collect()}
    assert len(rows) == 29
    assert rows[(2020, 2)] == (D("135000.00"), D("10000.00"), D("125000.00"), 1)
    assert rows[(2022, 11)] == (D("6400.00"), D("5000.00"), D("1400.00"), 1)
    assert rows[(2023, 8)] == (D("46500.00"), D("36000.00"), D("10500.00"), 3)
    assert rows[(2023, 12)] == (D("84200.00"), D("63300.00"), D("20900.00"), 3)
    assert rows[(2024, 4)] == (D("75400.00"), D("58600.00"), D("16800.00"), 4)
    assert rows[(2024, 6)] == (D("31200.00"), D("25200.00"), D("6000.00"), 3)
    assert rows[(2024, 8)] == (D("5500.00"), D("4600.00"), D("900.00"), 1)


def test_top_customers(seed):
    got = [(r.customer_id, r.total_loans, r.total_paid, r.payment_count, str(r.last_payment_date))
           for r in V.top_customers(seed["w"]).collect()]
    assert got == [(13, 1, D("405000.00"), 3, "2020-04-01"), (8, 1, D("288000.00"), 4, "2022-10-15"),
                   (4, 1, D("264000.00"), 6, "2024-05-01"), (12, 1, D("165000.00"), 5, "2023-12-01"),
                   (2, 1, D("86200.00"), 12, "2024-06-01"), (14, 1, D("63900.00"), 10, "2023-08-01"),
                   (3, 1, D("51000.00"), 3, "2024-06-20"), (1, 1, D("36000.00"), 5, "2024-06-15"),
                   (15, 1, D("11000.00"), 2, "2024-08-01")]


def test_status_distribution(seed):
    got = {(r.loan_status, r.customer_segment): (r.loan_count, r.total_loan_amount, round(r.avg_interest_rate, 6))
           for r in V.loan_status_distribution(seed["w"]).collect()}
    assert got == {("repaid", "retail"): (22, D("1960000.00"), 14.545455),
                   ("active", "sme"): (11, D("19500000.00"), 11.272727),
                   ("active", "retail"): (10, D("2370000.00"), 14.15),
                   ("active", "corporate"): (7, D("77000000.00"), 9.785714)}


def test_payment_by_method(seed):
    got = {r.method_name: (r.payment_count, r.total_amount, r.pct_of_total)
           for r in V.payment_by_method(seed["w"]).collect()}
    assert got == {"Bank Transfer": (17, D("1015200.00"), D("74.10")),
                   "M-Pesa Mobile Money": (28, D("189900.00"), D("13.86")),
                   "Online Payment": (5, D("165000.00"), D("12.04"))}


def test_branch_performance(seed):
    got = {r.branch_code: (r.loan_count, r.total_collected, r.total_interest_earned, round(r.avg_rate, 6))
           for r in V.branch_performance(seed["w"]).collect()}
    assert got == {"NBI-001": (2, D("441000.00"), D("382200.00"), 12.625),
                   "MBA-001": (2, D("374200.00"), D("275200.00"), 13.75),
                   "NKR-001": (1, D("264000.00"), D("64500.00"), 11.5),
                   "MCH-001": (1, D("165000.00"), D("43000.00"), 11.0),
                   "NYR-001": (1, D("63900.00"), D("9400.00"), 14.0),
                   "KSM-001": (1, D("51000.00"), D("14400.00"), 12.0),
                   "KSM-002": (1, D("11000.00"), D("1900.00"), 16.5)}


def test_fact_loans(seed):
    fl = {r.loan_id: (r.total_paid, r.payment_count, r.outstanding_balance)
          for r in seed["w"]["fact_loans"].collect()}
    assert fl[1] == (D("36000.00"), 5, D("114000.00"))
    assert fl[2] == (D("86200.00"), 12, D("-6200.00"))           # may go negative
    assert fl[5] == (D("0.00"), 0, D("50000.00"))
    assert fl[13] == (D("405000.00"), 3, D("14595000.00"))
    assert fl[15] == (D("11000.00"), 2, D("49000.00"))
    flags = seed["w"]["fact_loans"].agg(*[F.sum(F.col(c).cast("int")) for c in
                                          ("is_active", "is_repaid", "is_defaulted")]).first()
    assert tuple(flags) == (11, 3, 1)


def test_customer_summary_fan_out(seed):
    got = {r.customer_id: (r.total_loan_amount, r.last_payment_date)
           for r in V.customer_payment_summary(seed["src"]).collect()}
    assert got[1][0] == D("750000.00") and got[13][0] == D("45000000.00") and got[15][0] == D("120000.00")
    assert got[5] == (D("50000.00"), None)


def test_disbursed_date_uses_utc(seed):
    r = seed["w"]["fact_loans"].where("loan_id = 1").first()
    assert r.disbursement_date_sk == 20240115                      # 08:00+03 is 05:00 UTC


def test_load_with_customer_history(spark, tmp_path):
    src = seed_fixture.source_tables(spark)
    store = TableStore(spark, str(tmp_path) + "/wh")
    WH.load(spark, store, src, WH.FIXED_RUN_TS, customer_history=True)
    moved = src["customers"].withColumn("segment", F.when(F.col("customer_id") == 1, "sme")
                                        .otherwise(F.col("segment")))
    WH.load(spark, store, {**src, "customers": moved}, WH.SECOND_RUN_TS, customer_history=True)
    dc = store.read("dim_customer")
    assert dc.count() == 16 and dc.where("is_current").count() == 15
    c1 = {r.is_current: (r.customer_sk, r.segment) for r in dc.where("customer_id = 1").collect()}
    assert c1 == {False: (1, "retail"), True: (16, "sme")}
    assert store.read("fact_payments").count() == 50        # payments are not duplicated
