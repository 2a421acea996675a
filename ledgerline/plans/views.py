"""Named data products (warehouse views, operational views, guide queries).

Each view is a function of table DataFrames.  Where a view groups a
payment-grain fact by a coarser key and also counts distinct loans, the
payments are first reduced to one row per (key, loan): the shuffle then
moves loan-grain rows, and COUNT(DISTINCT) needs no row expansion.
Results are exact (sums of sums, counts of counts, max of max).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import mean_of, money_sum, pct
from ..sources import schemas as S

W = dict[str, DataFrame]


def _bcast_dates(w: W, *cols: str) -> DataFrame:
    # no hint: Spark broadcasts the calendar by its measured size
    return w["dim_date"].select(*cols)


def _desc(c: str) -> Column:
    # DESC puts NULLs first in the source system's ordering
    return F.col(c).desc_nulls_first()


# ------------------------------------------------------------- warehouse
def monthly_revenue(w: W) -> DataFrame:
    fp = w["fact_payments"]
    dd = _bcast_dates(w, "date_sk", "year", "month", "month_name")
    # a row per day before the calendar comes in
    days = fp.groupBy("date_sk").agg(F.sum("payment_amount").alias("_paid"), F.sum("principal_portion").alias("_principal"),
                                     F.sum("interest_portion").alias("_interest"), F.count("payment_sk").alias("_n"))
    return (days.join(dd, "date_sk")
            .groupBy("year", "month", "month_name")
            .agg(money_sum("_paid").alias("total_revenue"),
                 money_sum("_principal").alias("total_principal"),
                 money_sum("_interest").alias("total_interest"),
                 F.sum("_n").alias("payment_count"))
            .orderBy("year", "month"))


def _per_customer_loan(fp: DataFrame) -> DataFrame:
    return fp.groupBy("customer_sk", "loan_sk").agg(
        F.sum("payment_amount").alias("_paid"), F.count("payment_sk").alias("_n"),
        F.max("date_sk").alias("_last"))


def top_customers(w: W) -> DataFrame:
    per_loan = _per_customer_loan(w["fact_payments"])
    dc = w["dim_customer"].select("customer_sk", "customer_id", "full_name", "segment", "city")
    agg = (per_loan.join(dc, "customer_sk")
           .groupBy("customer_id", "full_name", "segment", "city")
           .agg(F.count_distinct("loan_sk").alias("total_loans"),
                F.sum("_paid").cast("decimal(38,2)").alias("total_paid"),
                F.sum("_n").alias("payment_count"),
                F.max("_last").alias("_last")))
    dd = _bcast_dates(w, F.col("date_sk").alias("_last"), F.col("full_date").alias("last_payment_date"))
    return (agg.join(dd, "_last").drop("_last")
            .orderBy(_desc("total_paid")))


def top5_customers(w: W) -> DataFrame:
    """Top 5 payers (ties broken by customer id)."""
    return top_customers(w).orderBy(_desc("total_paid"), "customer_id").limit(5)


def loan_status_distribution(w: W) -> DataFrame:
    """Counts payment rows per status and segment (the view reads the payment fact)."""
    return (w["fact_payments"].groupBy("loan_status", "customer_segment")
            .agg(F.count(F.lit(1)).alias("loan_count"),
                 money_sum("loan_amount").alias("total_loan_amount"),
                 mean_of(F.sum("interest_rate"), F.count("interest_rate")).alias("avg_interest_rate"))
            .orderBy(_desc("loan_count")))


def loan_status_distribution_by_loan(w: W) -> DataFrame:
    """Corrected variant: one row per loan from the loan fact."""
    fl = w["fact_loans"]
    status = (F.when(F.col("is_active"), "active").when(F.col("is_defaulted"), "defaulted")
              .when(F.col("is_repaid"), "repaid").otherwise("other"))
    return (fl.groupBy(status.alias("loan_status"), "customer_segment")
            .agg(F.count(F.lit(1)).alias("loan_count"),
                 money_sum("principal_amount").alias("total_loan_amount"),
                 mean_of(F.sum("interest_rate"), F.count("interest_rate")).alias("avg_interest_rate"))
            .orderBy(_desc("loan_count")))


def payment_by_method(w: W) -> DataFrame:
    pm = w["dim_payment_method"].select("method_sk", "method_name")
    agg = (w["fact_payments"].join(pm, "method_sk").groupBy("method_name")
           .agg(F.count("payment_sk").alias("payment_count"),
                money_sum("payment_amount").alias("total_amount")))
    # share of total: a window over the aggregated rows (one per method)
    total = F.sum("total_amount").over(Window.partitionBy())
    return (agg.select("method_name", "payment_count", "total_amount",
                       pct(F.col("total_amount"), total).cast("decimal(7,2)").alias("pct_of_total"))
            .orderBy(_desc("total_amount")))


def branch_performance(w: W) -> DataFrame:
    per_loan = (w["fact_payments"].groupBy("branch_code", "loan_sk")
                .agg(F.sum("payment_amount").alias("_paid"), F.sum("interest_portion").alias("_int"),
                     F.sum("interest_rate").alias("_rs"), F.count("interest_rate").alias("_rn")))
    return (per_loan.groupBy("branch_code")
            .agg(F.count(F.lit(1)).alias("loan_count"),
                 money_sum("_paid").alias("total_collected"),
                 money_sum("_int").alias("total_interest_earned"),
                 mean_of(F.sum("_rs"), F.sum("_rn")).alias("avg_rate"))
            .orderBy(_desc("total_collected")))


def warehouse_counts(w: W) -> DataFrame:
    names = ["dim_customer", "dim_loan", "dim_date", "dim_payment_method", "fact_payments", "fact_loans"]
    parts = [w[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(w: W) -> DataFrame:
    rev = w["fact_payments"].agg(money_sum("payment_amount")).scalar()  # scalar subquery
    return w["fact_loans"].agg(F.count(F.lit(1)).alias("total_loans"), rev.alias("total_revenue"))


def status_totals(w: W) -> DataFrame:
    return (w["fact_payments"].groupBy("loan_status")
            .agg(F.count(F.lit(1)).alias("payment_rows"), money_sum("loan_amount").alias("total_loan_amount")))


def revenue_by_segment(w: W) -> DataFrame:
    return (w["fact_payments"].groupBy("customer_segment")
            .agg(money_sum("payment_amount").alias("total_revenue"))
            .orderBy(_desc("total_revenue")))


def revenue_month_branch(w: W, years: int = 3) -> DataFrame:
    """Revenue per month and branch over the last ``years`` years of data."""
    fp = w["fact_payments"]
    dd = _bcast_dates(w, "date_sk", "full_date", "year", "month")
    newest = fp
    if "payment_year" in fp.columns:
        # the newest day lies in the newest partition: no other year is read for it
        newest = fp.where(F.col("payment_year") == fp.agg(F.max("payment_year")).scalar())
    # scalar subquery, evaluated once; every key is a calendar day
    anchor = newest.agg(F.to_date(F.max("date_sk").cast("string"), "yyyyMMdd")).scalar()
    j = fp.join(dd, "date_sk")
    if "payment_year" in fp.columns:
        # implied by the date bound; on the partition column it prunes years
        j = j.where(F.col("payment_year") >= F.year(anchor) - years)
    return (j.where(F.col("full_date") > F.add_months(anchor, -12 * years))
            .groupBy("year", "month", "branch_code")
            .agg(money_sum("payment_amount").alias("total_revenue"),
                 F.count(F.lit(1)).alias("payment_count")))


def disbursed_by_month(w: W, years: int = 2) -> DataFrame:
    fl = w["fact_loans"]
    dd = _bcast_dates(w, F.col("date_sk").alias("disbursement_date_sk"), "full_date", "year", "month")
    j = fl.join(dd, "disbursement_date_sk")
    anchor = j.agg(F.max("full_date")).scalar()
    return (j.where(F.col("full_date") > F.add_months(anchor, -12 * years))
            .groupBy("year", "month")
            .agg(F.count(F.lit(1)).alias("loans_disbursed"),
                 money_sum("principal_amount").alias("total_disbursed")))


def default_rate_by_segment(w: W) -> DataFrame:
    fl = w["fact_loans"]
    return (fl.groupBy("customer_segment")
            .agg(F.count(F.lit(1)).alias("loan_count"),
                 F.sum(F.col("is_defaulted").cast("int")).cast("long").alias("defaulted"),
                 mean_of(F.sum(F.col("is_defaulted").cast("int")), F.count(F.lit(1))).alias("default_rate")))


def interest_by_branch(w: W) -> DataFrame:
    return (w["fact_payments"].groupBy("branch_code")
            .agg(money_sum("interest_portion").alias("total_interest_earned")))


# ----------------------------------------------------------- operational
def active_loans(op: W) -> DataFrame:
    loans, cust = op["loans"], op["customers"]
    # no hint: the catalogue size is not bounded by construction; AQE
    # broadcasts it at runtime when its measured size is small
    lp = op["loan_products"].select("product_id", "product_name")
    return (loans.where(F.col("status") == "active")
            .join(cust.select("customer_id", F.col("full_name").alias("customer_name"), "email", "segment"),
                  "customer_id")
            .join(lp, "product_id", "left")
            .select("loan_id", "customer_name", "email", "segment", "product_name", "amount",
                    "interest_rate", "tenure_months", "outstanding_balance", "status", "disbursed_at",
                    "maturity_date"))


def _payments_per_loan(payments: DataFrame) -> DataFrame:
    return payments.groupBy("loan_id").agg(
        F.count("payment_id").alias("_n"), F.sum("amount").alias("_paid"),
        F.max("payment_date").alias("_last"))


def customer_payment_summary(op: W, fan_out: bool = True) -> DataFrame:
    """Per customer: loans, loan amount, payments, paid, last payment date.

    ``fan_out=True`` keeps the source view's semantics: its loan x payment
    join repeats each loan amount once per payment.  Computed exactly from
    one pre-aggregated row per loan (amount x max(payments, 1)) instead of
    materialising the fan-out.  ``fan_out=False`` counts each loan once.
    """
    per_loan = op["loans"].select("loan_id", "customer_id", "amount") \
        .join(_payments_per_loan(op["payments"]), "loan_id", "left")
    weight = F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1)) if fan_out else F.lit(1)
    per_cust = per_loan.groupBy("customer_id").agg(
        F.count("loan_id").alias("total_loans"),
        F.sum(F.col("amount") * weight).cast("decimal(38,2)").alias("total_loan_amount"),
        F.sum(F.coalesce(F.col("_n"), F.lit(0))).cast("long").alias("total_payments"),
        F.sum("_paid").alias("_paid"),
        F.max("_last").alias("last_payment_date"))
    return (op["customers"].select("customer_id", "full_name", "segment")
            .join(per_cust, "customer_id", "left")
            .select("customer_id", "full_name", "segment",
                    F.coalesce(F.col("total_loans"), F.lit(0)).cast("long").alias("total_loans"),
                    "total_loan_amount",
                    F.coalesce(F.col("total_payments"), F.lit(0)).cast("long").alias("total_payments"),
                    F.coalesce(F.col("_paid"), F.lit(0)).cast("decimal(38,2)").alias("total_paid"),
                    "last_payment_date"))


def loan_payment_counts(op: W) -> DataFrame:
    """Each loan with its payment count (correlated COUNT -> aggregate + left join)."""
    n = op["payments"].groupBy("loan_id").agg(F.count(F.lit(1)).alias("_n"))
    return (op["loans"].select("loan_id", "amount", "outstanding_balance", "status")
            .join(n, "loan_id", "left")
            .select("loan_id", "amount", "outstanding_balance", "status",
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("payment_count")))


def loan_points(op: W, statuses: tuple[str, ...] = ("active", "defaulted"),
                method: str = "cash") -> DataFrame:
    """Point reads: payments of one method on loans in a status list, in
    loan / payment order (equality, IN list, conjunction, ORDER BY)."""
    loans = op["loans"].where(F.col("status").isin(*statuses)).select("loan_id", "status")
    return (op["payments"].where((F.col("payment_method") == method) & (F.col("amount") > 0))
            .join(loans, "loan_id", "left_semi")
            .select("payment_id", "loan_id", "amount", "payment_method", "payment_date")
            .orderBy("loan_id", "payment_id"))


def freshness(w: W, now: Column | None = None) -> DataFrame:
    """Time since the latest load, per warehouse table."""
    now = now if now is not None else F.current_timestamp().cast(S.TS)
    parts = []
    for n in [t for t in w if "etl_loaded_at" in w[t].columns]:
        parts.append(w[n].agg(F.max("etl_loaded_at").alias("last_loaded_at"))
                     .select(F.lit(n).alias("table_name"), "last_loaded_at"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("lag_seconds",
                          (F.unix_micros(now.cast("timestamp")) -
                           F.unix_micros(F.col("last_loaded_at").cast("timestamp"))) / 1e6)


# ------------------------------------------------------ load products
def calendar_activity(w: W) -> DataFrame:
    """Calendar rows with the number of payments on each day."""
    per_day = w["fact_payments"].groupBy("date_sk").agg(F.count(F.lit(1)).alias("_n"))
    return (w["dim_date"].join(per_day, "date_sk", "left")
            .withColumn("payments_on_day", F.coalesce(F.col("_n"), F.lit(0)).cast("long")).drop("_n"))


def products_in_use(w: W) -> DataFrame:
    per = w["dim_loan"].groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return (w["dim_product"].join(per.where(F.col("product_id").isNotNull()), "product_id", "left")
            .select("product_sk", "product_id", "product_name", "product_type",
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("loan_count")))


def methods_in_use(w: W) -> DataFrame:
    per = w["fact_payments"].groupBy("method_sk").agg(F.count(F.lit(1)).alias("_n"))
    return (w["dim_payment_method"].join(per, "method_sk", "left")
            .select("method_sk", "method_code", "method_name",
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("payment_count")))


def late_pending(store) -> DataFrame:
    """Payments staged by run 1 but not loaded by it (parent not extracted
    yet, or filtered out), and whether run 2 loaded them."""
    v1 = store.read_all(1)
    v2 = store.read_all(2)
    sp = v1["stg_payments"].select("payment_id", "loan_id", "payment_date")
    pending = sp.join(v1["fact_payments"].select("payment_id"), "payment_id", "left_anti")
    seen = v1["stg_loans"].select("loan_id").withColumn("loan_seen_in_run1", F.lit(True))
    loaded = v2["fact_payments"].select("payment_id").withColumn("loaded_in_run2", F.lit(True))
    # by payment first: those rows lie by payment already
    return (pending.join(loaded, "payment_id", "left").join(seen, "loan_id", "left")
            .select("payment_id", "loan_id", "payment_date",
                    F.coalesce(F.col("loan_seen_in_run1"), F.lit(False)).alias("loan_seen_in_run1"),
                    F.coalesce(F.col("loaded_in_run2"), F.lit(False)).alias("loaded_in_run2")))
