"""Extract -> stage -> dimensions -> facts, as DataFrame transformations.

Every step is a pure function from table versions to the next version;
``ledgerline.plans.warehouse`` writes and commits them.  Join order is
chosen for scale: the loan-grain context (loans x customers x keys) is
built first and partitioned by ``loan_id``; the payment-grain data is
shuffled once, on ``loan_id``, which its source window already uses.
Calendar and payment methods are broadcast after a count of the very table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import dim_date
from ..operators.keys import assign_dense_keys, next_key_start
from ..operators.upsert import absent, one_per_key, scd2, upsert, with_dup_count
from ..sources import schemas as S
from ..sources.readers import extract_customers, extract_loans, extract_payments

DIM_CUSTOMER_UPDATE = ["full_name", "email", "phone", "city", "country", "segment"]
DIM_LOAN_UPDATE = ["status", "branch_code", "maturity_date"]
FACT_LOANS_UPDATE = ["outstanding_balance", "total_paid", "payment_count",
                     "is_active", "is_defaulted", "is_repaid"]

DIM_CUSTOMER_COLS = ["customer_sk", "customer_id", "full_name", "email", "phone", "city", "country",
                     "segment", "effective_date", "expiry_date", "is_current", "created_at"]
DIM_LOAN_COLS = ["loan_sk", "loan_id", "customer_id", "product_id", "amount", "interest_rate",
                 "tenure_months", "status", "branch_code", "disbursed_at", "maturity_date", "created_at"]
FACT_PAYMENT_COLS = ["payment_sk", "payment_id", "customer_sk", "loan_sk", "date_sk", "method_sk",
                     "payment_amount", "principal_portion", "interest_portion", "penalty_portion",
                     "loan_amount", "interest_rate", "customer_segment", "loan_status", "branch_code",
                     "etl_loaded_at"]
FACT_LOAN_COLS = ["loan_fact_sk", "loan_id", "customer_sk", "loan_sk", "disbursement_date_sk",
                  "maturity_date_sk", "principal_amount", "interest_rate", "tenure_months",
                  "outstanding_balance", "total_paid", "payment_count", "is_active", "is_defaulted",
                  "is_repaid", "customer_segment", "branch_code", "etl_loaded_at"]


def ts_lit(run_ts: str) -> Column:
    return F.lit(run_ts).cast(S.TS)


# --------------------------------------------------------------- extract
def stage(src: dict[str, DataFrame], run_ts: str) -> dict[str, DataFrame]:
    t = ts_lit(run_ts)
    return {
        "stg_customers": extract_customers(src["customers"]).withColumn("etl_loaded_at", t),
        "stg_loans": extract_loans(src["loans"]).withColumn("etl_loaded_at", t),
        "stg_payments": one_per_key(extract_payments(src["payments"]), "payment_id").withColumn("etl_loaded_at", t),
    }


# ------------------------------------------------------------ dimensions
SK_COLS = {"dim_customer": "customer_sk", "dim_loan": "loan_sk", "dim_product": "product_sk",
           "fact_payments": "payment_sk", "fact_loans": "loan_fact_sk"}


def load_dim_customer(existing: DataFrame | None, stg_customers: DataFrame, run_ts: str,
                      key_start: int | None = None, refuse: str | None = None) -> DataFrame:
    t = ts_lit(run_ts)
    staged = stg_customers.select("customer_id", *DIM_CUSTOMER_UPDATE)
    out = upsert(existing, staged, "customer_id", DIM_CUSTOMER_UPDATE, sk_col="customer_sk", dup_check=True,
                 on_update={"is_current": F.lit(True)},
                 on_insert={"effective_date": F.to_date(t), "expiry_date": F.lit(None).cast("date"),
                            "is_current": F.lit(True), "created_at": t},
                 columns=[c for c in DIM_CUSTOMER_COLS if c != "customer_sk"], key_start=key_start, refuse=refuse)
    return out.select(*DIM_CUSTOMER_COLS, "_op", "_dup")


def load_dim_customer_history(existing: DataFrame | None, stg_customers: DataFrame, run_ts: str, refuse: str | None = None) -> DataFrame:
    """Type-2 variant of ``dim_customer``: a changed attribute closes the
    current row and opens a new version with a new key (facts pick the
    current row through ``is_current``)."""
    staged = with_dup_count(stg_customers.select("customer_id", *DIM_CUSTOMER_UPDATE, ts_lit(run_ts).alias("created_at")),
                            "customer_id", refuse)
    out = scd2(existing, staged, "customer_id", DIM_CUSTOMER_UPDATE, "customer_sk", F.to_date(ts_lit(run_ts)),
               other_cols=["created_at"])
    return out.select(*DIM_CUSTOMER_COLS, "_dup")


def load_dim_loan(existing: DataFrame | None, stg_loans: DataFrame, run_ts: str,
                  key_start: int | None = None, refuse: str | None = None) -> DataFrame:
    staged = stg_loans.select(*[c for c in DIM_LOAN_COLS if c not in ("loan_sk", "created_at")])
    out = upsert(existing, staged, "loan_id", DIM_LOAN_UPDATE, sk_col="loan_sk", dup_check=True,
                 on_insert={"created_at": ts_lit(run_ts)},
                 columns=[c for c in DIM_LOAN_COLS if c != "loan_sk"], key_start=key_start, refuse=refuse)
    return out.select(*DIM_LOAN_COLS, "_op", "_dup")


def load_dim_product(existing: DataFrame | None, loan_products: DataFrame,
                     key_start: int | None = None, refuse: str | None = None) -> DataFrame:
    staged = loan_products.select("product_id", "product_name", "product_type")
    out = upsert(existing, staged, "product_id", ["product_name", "product_type"], sk_col="product_sk",
                 dup_check=True, columns=["product_id", "product_name", "product_type"], key_start=key_start, refuse=refuse)
    return out.select("product_sk", "product_id", "product_name", "product_type", "_op", "_dup")


def dim_payment_method(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, code, name) for i, (code, name) in enumerate(S.PAYMENT_METHOD_ROWS)]
    return spark.createDataFrame(rows, "method_sk int, method_code string, method_name string")


def calendar(spark: SparkSession) -> DataFrame:
    return dim_date(spark)


#: A side of up to so many narrow rows is broadcast.
MOST_BROADCAST = 100_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its own count is at most MOST_BROADCAST; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


# ----------------------------------------------------------------- facts
def loan_context(stg: dict[str, DataFrame], dim_customer: DataFrame, dim_loan: DataFrame) -> DataFrame:
    """Loan-grain rows that pass every inner join of the fact loads:
    staged loan x staged customer x current customer key x loan key."""
    sc = stg["stg_customers"].select("customer_id", F.col("segment").alias("customer_segment"))
    dc = dim_customer.where(F.col("is_current")).select("customer_id", "customer_sk")
    dl = dim_loan.select("loan_id", "loan_sk")
    if "_op" in dim_customer.columns:
        dc = dc.drop("_op")
    sl = stg["stg_loans"].select("loan_id", "customer_id", F.col("amount").alias("loan_amount"),
                                 "interest_rate", "tenure_months", F.col("status").alias("loan_status"),
                                 "branch_code", "disbursed_at", "maturity_date")
    # holders first, one row per customer: loans meet them in one join, whose hot keys Spark can split
    return sl.join(sc.join(dc, "customer_id"), "customer_id").join(dl, "loan_id")


def fact_payment_candidates(spark: SparkSession, stg: dict[str, DataFrame], ctx: DataFrame,
                            run_ts: str, dd: DataFrame | None = None,
                            methods: DataFrame | None = None) -> DataFrame:
    keyed = _with_keys(spark, stg["stg_payments"], dd, methods)
    return keyed.join(ctx, "loan_id").select(*CANDIDATE_COLS, ts_lit(run_ts).alias("etl_loaded_at"))


CANDIDATE_COLS = [c for c in FACT_PAYMENT_COLS if c not in ("payment_sk", "etl_loaded_at")]


def _with_keys(spark: SparkSession, payments: DataFrame, dd: DataFrame | None, methods: DataFrame | None) -> DataFrame:
    """What a fact takes from its payment, with day and method as keys: the rows are narrow before they are shuffled."""
    dd = dd if dd is not None else calendar(spark)
    methods = methods if methods is not None else dim_payment_method(spark)
    dd = broadcast_if_small(dd.select("date_sk", F.col("full_date").alias("payment_date")))
    pm = broadcast_if_small(methods.select("method_sk", F.col("method_code").alias("payment_method")))
    return payments.join(dd, "payment_date").join(pm, "payment_method", "left").select(
        "payment_id", "loan_id", "date_sk", "method_sk", F.col("amount").alias("payment_amount"),
        "principal_portion", "interest_portion", "penalty_portion")


def with_payment_keys(rows: DataFrame, start: int, run_ts: str) -> DataFrame:
    """Fact rows of candidates; the load stamp is the same for all and joins them after they have moved."""
    keyed = assign_dense_keys(rows.drop("etl_loaded_at"), ["payment_id"], "payment_sk", start)
    return keyed.withColumn("etl_loaded_at", ts_lit(run_ts)).select(*FACT_PAYMENT_COLS)


def new_fact_payments(existing: DataFrame | None, spark: SparkSession, stg: dict[str, DataFrame], ctx: DataFrame, run_ts: str,
                      dd: DataFrame | None = None, methods: DataFrame | None = None, key_start: int | None = None,
                      keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rows to insert (insert-only by payment_id): known payments drop out before they meet their loans.

    ``keep`` may store the rows before they get their keys: the shuffles that made them are then over when they are
    laid out by key, and the sampling of key ranges does not join them again."""
    fresh = _with_keys(spark, stg["stg_payments"], dd, methods)
    if existing is not None:
        fresh = absent(existing, fresh, "payment_id")
    rows = keep(fresh.join(ctx, "loan_id").select(*CANDIDATE_COLS))
    start = key_start if key_start is not None else next_key_start(existing, "payment_sk")
    return with_payment_keys(rows, start, run_ts)


def fact_loan_rows(spark: SparkSession, stg: dict[str, DataFrame], ctx: DataFrame, run_ts: str,
                   dd: DataFrame | None = None, pay_totals: DataFrame | None = None) -> DataFrame:
    """Loan-grain fact rows.  ``pay_totals`` (loan_id, _paid, _n) replaces
    the aggregation of staged payments when the caller keeps running
    totals (micro-batch mode); a context that holds the totals needs neither."""
    dd = dd if dd is not None else calendar(spark)
    ddi = broadcast_if_small(dd.select(F.col("date_sk").alias("disbursement_date_sk"), F.col("full_date").alias("_dfd")))
    ddm = broadcast_if_small(dd.select(F.col("date_sk").alias("maturity_date_sk"), F.col("full_date").alias("_mfd")))
    # Lateral aggregate -> one grouped pass over staged payments (partial
    # aggregation before the shuffle), joined back per loan.
    if "_paid" not in ctx.columns:
        ctx = ctx.join(pay_totals if pay_totals is not None else payment_totals(stg["stg_payments"]), "loan_id", "left")
    paid = F.coalesce(F.col("_paid"), F.lit(0).cast(S.MONEY))
    return (
        ctx.join(ddi, F.to_date(ctx["disbursed_at"]) == F.col("_dfd"), "left")
        .join(ddm, ctx["maturity_date"] == F.col("_mfd"), "left")
        .select(
            "loan_id", "customer_sk", "loan_sk", "disbursement_date_sk", "maturity_date_sk",
            F.col("loan_amount").alias("principal_amount"), "interest_rate", "tenure_months",
            (F.col("loan_amount") - paid).cast(S.MONEY).alias("outstanding_balance"),
            paid.cast(S.MONEY).alias("total_paid"),
            F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("payment_count"),
            (F.col("loan_status") == "active").alias("is_active"),
            (F.col("loan_status") == "defaulted").alias("is_defaulted"),
            (F.col("loan_status") == "repaid").alias("is_repaid"),
            "customer_segment", "branch_code",
            ts_lit(run_ts).alias("etl_loaded_at"),
        )
    )


def load_fact_loans(existing: DataFrame | None, rows: DataFrame, run_ts: str,
                    key_start: int | None = None) -> DataFrame:
    out = upsert(existing, rows, "loan_id", FACT_LOANS_UPDATE, sk_col="loan_fact_sk",
                 on_update={"etl_loaded_at": ts_lit(run_ts)},
                 columns=[c for c in FACT_LOAN_COLS if c != "loan_fact_sk"], key_start=key_start)
    return out.select(*FACT_LOAN_COLS, "_op")


def payment_totals(payments: DataFrame) -> DataFrame:
    """Gross amount and count per loan (partial aggregation before the shuffle)."""
    return payments.groupBy("loan_id").agg(F.sum("amount").alias("_paid"), F.count(F.lit(1)).alias("_n"))


def merge_totals(current: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Running per-loan totals plus a batch's totals (loan grain)."""
    if current is None:
        return delta.select("loan_id", F.col("_paid").cast("decimal(38,2)").alias("_paid"),
                            F.col("_n").cast("long").alias("_n"))
    c, d = current.alias("c"), delta.alias("d")
    return c.join(d, F.col("c.loan_id") == F.col("d.loan_id"), "full_outer").select(
        F.coalesce(F.col("c.loan_id"), F.col("d.loan_id")).alias("loan_id"),
        (F.coalesce(F.col("c._paid"), F.lit(0)) + F.coalesce(F.col("d._paid"), F.lit(0)))
        .cast("decimal(38,2)").alias("_paid"),
        (F.coalesce(F.col("c._n"), F.lit(0)) + F.coalesce(F.col("d._n"), F.lit(0))).cast("long").alias("_n"))


# ------------------------------------------------------------- one run
@dataclass
class RunResult:
    tables: dict[str, DataFrame]
    staged: dict[str, DataFrame]
    new_payments: DataFrame
    notes: dict = field(default_factory=dict)


Sink = Callable[[str, DataFrame], DataFrame]


def _identity(name: str, df: DataFrame) -> DataFrame:
    return df


def _parallel(steps: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run independent steps from driver threads (their Spark jobs overlap);
    the first failure is re-raised."""
    from concurrent.futures import ThreadPoolExecutor
    from contextvars import copy_context
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        futures = {k: pool.submit(copy_context().run, fn) for k, fn in steps.items()}
        return {k: f.result() for k, f in futures.items()}


def run_load(spark: SparkSession, current: dict[str, DataFrame] | None,
             src: dict[str, DataFrame], run_ts: str, sink: Sink = _identity,
             key_starts: dict[str, int | None] | None = None,
             pay_totals: DataFrame | None = None, customer_history: bool = False, refuse_repeats: bool = False) -> RunResult:
    """One ETL run over the current warehouse version (None = empty).

    ``sink(name, df)`` is called once per produced table, in dependency
    order, and returns the DataFrame later steps read.  The store's sink
    writes the table and reads it back, so each stage is computed once
    (staging zone -> dimensions -> facts); the identity sink composes
    the whole run lazily.  With ``refuse_repeats`` a dimension fails on a batch that
    holds a key twice before it is written; else its writer sees ``_dup``.
    """
    cur = current or {}
    ks = key_starts or {}
    refuse = {t: t if refuse_repeats else None for t in ("dim_customer", "dim_loan", "dim_product")}
    # independent tables of one step are submitted as concurrent Spark jobs
    stg = _parallel({k: (lambda k=k, v=v: sink(k, v)) for k, v in stage(src, run_ts).items()})

    def dim_customer_step():
        if customer_history:
            return sink("dim_customer", load_dim_customer_history(cur.get("dim_customer"),
                                                                  stg["stg_customers"], run_ts, refuse["dim_customer"]))
        return sink("dim_customer", load_dim_customer(cur.get("dim_customer"), stg["stg_customers"], run_ts,
                                                      ks.get("dim_customer"), refuse["dim_customer"]))

    dims = _parallel({
        "dim_customer": dim_customer_step,
        "dim_loan": lambda: sink("dim_loan", load_dim_loan(cur.get("dim_loan"), stg["stg_loans"], run_ts,
                                                           ks.get("dim_loan"), refuse["dim_loan"])),
        "dim_product": lambda: sink("dim_product", load_dim_product(cur.get("dim_product"),
                                                                    src["loan_products"], ks.get("dim_product"), refuse["dim_product"])),
    })
    dim_c, dim_l, dim_p = dims["dim_customer"], dims["dim_loan"], dims["dim_product"]
    dd = cur.get("dim_date")
    if dd is None:
        dd = sink("dim_date", calendar(spark))
    pm = cur.get("dim_payment_method")
    if pm is None:
        pm = sink("dim_payment_method", dim_payment_method(spark))
    # loan-grain context feeds both facts: materialised once (scratch table)
    # with each loan's totals: they meet in the partitions of the last join, and fact rows need no further join by loan
    pay = pay_totals if pay_totals is not None else payment_totals(stg["stg_payments"])
    ctx = sink("_loan_context", loan_context(stg, dim_c, dim_l).join(pay, "loan_id", "left"))
    new_pay = sink("fact_payments", new_fact_payments(cur.get("fact_payments"), spark, stg, ctx, run_ts, dd, pm, ks.get("fact_payments"),
                                                      lambda rows: sink("_payment_candidates", rows)))
    rows = fact_loan_rows(spark, stg, ctx, run_ts, dd)
    fl = sink("fact_loans", load_fact_loans(cur.get("fact_loans"), rows, run_ts, ks.get("fact_loans")))
    if cur.get("fact_payments") is not None:
        fp = cur["fact_payments"].unionByName(new_pay.select(*cur["fact_payments"].columns))
    else:
        fp = new_pay
    tables = {
        "dim_customer": dim_c.drop("_op", "_dup"), "dim_loan": dim_l.drop("_op", "_dup"),
        "dim_product": dim_p.drop("_op", "_dup"),
        "dim_date": dd, "dim_payment_method": pm,
        "fact_payments": fp.select(*FACT_PAYMENT_COLS), "fact_loans": fl.drop("_op"),
    }
    return RunResult(tables=tables, staged=stg, new_payments=new_pay)
