"""Adapter from the driver's star tables to the lending model.

``customer``/``nation``/``region`` -> customers, ``orders`` -> loans,
``lineitem`` -> payments.  Every column is a plain expression over one
row, except ``payment_id`` which numbers the lines of one order (a window
per ``l_orderkey``; an order holds a bounded number of lines, so the
window groups stay small however large the table grows).

Dates move forward by 336 months (28 years keep weekday and leap
pattern) so that the source years fall inside the 2018-2050 calendar.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas as S

SHIFT_MONTHS = 336
# A customer with at least this many loans is upgraded to 'corporate' in
# the second customer snapshot (the SCD2 scenario).
SEGMENT_UPGRADE_LOANS = 20
# As-of time of the point-in-time state query over the change log.
STATE_AS_OF = "2024-01-10 00:00:00"
# Snapshot cut used by the incremental scenario (run 1 sees data before it).
SNAPSHOT_CUTOFF = "2028-01-01"
# The loan extract of run 1 lags the payment extract by this many days.
LOAN_EXTRACT_LAG_DAYS = 30

# ---------------------------------------------------------------------------
# Fixed values of the mapping.
# ---------------------------------------------------------------------------
SEGMENT_OF_MKTSEGMENT = {
    "BUILDING": "retail", "HOUSEHOLD": "retail",
    "FURNITURE": "sme", "AUTOMOBILE": "sme",
    "MACHINERY": "corporate",
}
METHOD_OF_FLAGS = {
    "AF": "mpesa", "AO": "bank_transfer", "NF": "cash",
    "NO": "cheque", "RF": "online", "RO": "unlisted",
}
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def shift(ts: Column) -> Column:
    return ts + F.make_ym_interval(F.lit(0), F.lit(SHIFT_MONTHS))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    return (
        c.join(geo, c.c_nationkey == geo.n_nationkey, "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.test")).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("national_id"),
            F.lit(None).cast("date").alias("date_of_birth"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            _case(F.col("c_mktsegment"), SEGMENT_OF_MKTSEGMENT).alias("segment"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.lit(None).cast(S.TS).alias("created_at"),
            F.lit(None).cast(S.TS).alias("updated_at"),
        )
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "repaid")
        .when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "P",
              F.when(k % 3 == 0, "pending").when(k % 3 == 1, "defaulted").otherwise("written_off"))
    )
    created = shift(F.col("o_orderdate"))
    tenure = F.when(k % 5 == 2, F.lit(360)).otherwise(12 + (k % 5) * 12).cast("int")
    amount = F.col("o_totalprice").cast(S.MONEY)
    return (
        o.select(
            k.alias("loan_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(k % 17 == 0, F.lit(None)).otherwise(1 + k % 5).cast("int").alias("product_id"),
            amount.alias("amount"),
            (F.lit(9.5) + (k % 16) * 0.5).cast(S.RATE).alias("interest_rate"),
            tenure.alias("tenure_months"),
            status.alias("status"),
            created.alias("_created"),
            F.concat(F.lit("BR-"), F.lpad((F.col("o_custkey") % 25).cast("string"), 3, "0")).alias("branch_code"),
        )
        .select(
            "loan_id", "customer_id", "product_id", "amount", "interest_rate", "tenure_months",
            "status",
            F.when(F.col("status") == "pending", F.lit(None).cast(S.TS))
             .otherwise(F.col("_created")).alias("disbursed_at"),
            F.when(F.col("status") == "pending", F.lit(None).cast("date"))
             .otherwise(F.add_months(F.to_date("_created"), F.col("tenure_months"))).alias("maturity_date"),
            F.col("amount").alias("outstanding_balance"),
            F.lit(None).cast("string").alias("loan_officer"),
            "branch_code",
            F.col("_created").alias("created_at"),
            F.lit(None).cast(S.TS).alias("updated_at"),
        )
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    # Whole rows are unique, so ordering by every column numbers lines stably.
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    amount = F.col("l_extendedprice").cast(S.MONEY)
    principal = F.round(F.col("amount") * F.lit(Decimal("0.75")), 2).cast(S.MONEY)
    penalty = (F.when(F.col("l_tax") == 0, F.lit(None))
               .otherwise(F.round(F.col("amount") * F.col("l_tax").cast("decimal(4,2)")
                                  * F.lit(Decimal("0.01")), 2)).cast(S.MONEY))
    return (
        li.select(
            (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("payment_id"),
            F.col("l_orderkey").alias("loan_id"),
            amount.alias("amount"),
            F.col("l_tax"),
            _case(F.concat(F.col("l_returnflag"), F.col("l_linestatus")), METHOD_OF_FLAGS).alias("payment_method"),
            F.to_date(shift(F.col("l_shipdate"))).alias("payment_date"),
        )
        .select(
            "payment_id", "loan_id", "amount",
            principal.alias("principal_portion"),
            (F.col("amount") - principal).cast(S.MONEY).alias("interest_portion"),
            penalty.alias("penalty_portion"),
            "payment_method",
            F.lit(None).cast("string").alias("reference_number"),
            "payment_date",
            F.lit(None).cast("string").alias("recorded_by"),
            F.lit(None).cast("string").alias("notes"),
            F.col("payment_date").cast(S.TS).alias("created_at"),
        )
    )


def loan_products(spark: SparkSession) -> DataFrame:
    rows = [
        (i + 1, name, ptype, Decimal(lo), Decimal(hi), tmin, tmax, True, None)
        for i, (name, ptype, lo, hi, tmin, tmax) in enumerate(S.LOAN_PRODUCT_ROWS)
    ]
    return spark.createDataFrame(rows, S.LOAN_PRODUCTS)


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": customers(spark, sf_dir),
        "loans": loans(spark, sf_dir),
        "payments": payments(spark, sf_dir),
        "loan_products": loan_products(spark),
    }


def paid_off_flip(loans_df: DataFrame, payments_df: DataFrame) -> DataFrame:
    """Second source snapshot of loans: active loans whose gross payments
    reach the amount are marked repaid (a real status change per key)."""
    paid = payments_df.groupBy("loan_id").agg(F.sum("amount").alias("_paid"))
    return (
        loans_df.join(paid, "loan_id", "left")
        .withColumn("status", F.when((F.col("status") == "active") & (F.col("_paid") >= F.col("amount")),
                                     F.lit("repaid")).otherwise(F.col("status")))
        .drop("_paid")
    )


def in_first_snapshot() -> Column:
    """Whether the first snapshot holds a loan."""
    return F.col("created_at") < F.date_sub(F.lit(SNAPSHOT_CUTOFF).cast("date"), LOAN_EXTRACT_LAG_DAYS).cast(S.TS)


def first_snapshot(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Run-1 view of the source: payments before the cut, loans created
    before the cut minus the extract lag (so some payments arrive before
    their loan, and are picked up by the next run)."""
    cut = F.lit(SNAPSHOT_CUTOFF).cast("date")
    return {
        **src,
        "loans": src["loans"].where(in_first_snapshot()),
        "payments": src["payments"].where(F.col("payment_date") < cut),
    }


def second_snapshot(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {**src, "loans": paid_off_flip(src["loans"], src["payments"])}


def customers_second_snapshot(customers_df: DataFrame, loans_df: DataFrame) -> DataFrame:
    """Customers with many loans move to the corporate segment."""
    n = loans_df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    return (customers_df.join(n, "customer_id", "left")
            .withColumn("segment", F.when(F.coalesce(F.col("_n"), F.lit(0)) >= SEGMENT_UPGRADE_LOANS,
                                          F.lit("corporate")).otherwise(F.col("segment")))
            .drop("_n"))
