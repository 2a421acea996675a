"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from . import views as V
from ..operators import changes as CH
from ..operators import posting as PO
from ..operators import quality as DQ
from ..functions import exprs as EX
from ..operators import upsert as UP
from ..operators.runlog import RunLog
from ..session import shuffles_released
from ..sources import spoiled as SP
from ..sources import testdata as TD
from ..sources.store import TableStore
from . import warehouse as WH

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Q, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Q) -> Q:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


_STREAMS: dict = {}


def _folder(spark, what):
    import uuid
    from ..session import scratch_path
    return scratch_path(spark, what, uuid.uuid4().hex)


def _once(build):
    """The store of a scenario, built once per session for the queries on it."""
    def get(spark, d):
        k = (spark.sparkContext.applicationId, d, build.__name__)
        if k not in _STREAMS:
            _STREAMS[k] = build(spark, d)
        return _STREAMS[k]
    return get


def _w(spark, d):
    return WH.tables(spark, d, "full")


def _inc(spark, d):
    return WH.tables(spark, d, "incremental")


def _op(spark, d):
    return WH.operational(spark, d)


# ------------------------------------------------------------ views K3-K7
register("monthly_revenue", O.with_full("""
SELECT year, month, month_name, total_revenue, total_principal, total_interest, payment_count
FROM (SELECT DISTINCT date_sk // 100 AS ym, year, month, month_name FROM dim_date)
JOIN (SELECT date_sk // 100 AS ym, CAST(SUM(payment_amount) AS DECIMAL(38,2)) AS total_revenue,
             CAST(SUM(principal_portion) AS DECIMAL(38,2)) AS total_principal,
             CAST(SUM(interest_portion) AS DECIMAL(38,2)) AS total_interest, COUNT(*) AS payment_count
      FROM fact_payments GROUP BY 1) USING (ym)
ORDER BY ym"""))(
    lambda s, d: V.monthly_revenue(_w(s, d)))

TOP_CUSTOMERS_SQL = """
SELECT customer_id, full_name, segment, city, COUNT(DISTINCT loan_sk) AS total_loans,
       CAST(SUM(paid) AS DECIMAL(38,2)) AS total_paid, CAST(SUM(n) AS BIGINT) AS payment_count,
       CAST(strptime(CAST(MAX(last_day) AS VARCHAR), '%Y%m%d') AS DATE) AS last_payment_date
FROM (SELECT customer_sk, loan_sk, SUM(payment_amount) AS paid, COUNT(*) AS n, MAX(date_sk) AS last_day
      FROM fact_payments GROUP BY ALL)
NATURAL JOIN (SELECT customer_sk, customer_id, full_name, segment, city FROM dim_customer)
GROUP BY ALL"""
register("top_customers", O.with_full(TOP_CUSTOMERS_SQL + " ORDER BY total_paid DESC NULLS FIRST"))(
    lambda s, d: V.top_customers(_w(s, d)))
register("top5_customers", O.with_full(
    "SELECT * FROM (" + TOP_CUSTOMERS_SQL + ") t ORDER BY total_paid DESC NULLS FIRST, customer_id LIMIT 5"))(
    lambda s, d: V.top5_customers(_w(s, d)))

register("status_distribution", O.with_full("""
SELECT loan_status, customer_segment, COUNT(*) AS loan_count,
       CAST(SUM(loan_amount) AS DECIMAL(38,2)) AS total_loan_amount,
       CAST(SUM(interest_rate) AS DOUBLE) / CAST(NULLIF(COUNT(interest_rate), 0) AS DOUBLE) AS avg_interest_rate
FROM fact_payments GROUP BY loan_status, customer_segment ORDER BY loan_count DESC NULLS FIRST"""))(
    lambda s, d: V.loan_status_distribution(_w(s, d)))

register("status_distribution_by_loan", O.with_full("""
SELECT CASE WHEN is_active THEN 'active' WHEN is_defaulted THEN 'defaulted' WHEN is_repaid THEN 'repaid'
            ELSE 'other' END AS loan_status,
       customer_segment, COUNT(*) AS loan_count,
       CAST(SUM(principal_amount) AS DECIMAL(38,2)) AS total_loan_amount,
       CAST(SUM(interest_rate) AS DOUBLE) / CAST(NULLIF(COUNT(interest_rate), 0) AS DOUBLE) AS avg_interest_rate
FROM fact_loans GROUP BY 1, 2"""))(
    lambda s, d: V.loan_status_distribution_by_loan(_w(s, d)))

register("payment_by_method", O.with_full("""
SELECT method_name, payment_count, total_amount,
       CAST(ROUND(100 * total_amount / (SELECT NULLIF(SUM(payment_amount), 0) FROM fact_payments WHERE method_sk IS NOT NULL), 2)
            AS DECIMAL(7,2)) AS pct_of_total
FROM dim_payment_method
NATURAL JOIN (SELECT method_sk, COUNT(*) AS payment_count, CAST(SUM(payment_amount) AS DECIMAL(38,2)) AS total_amount
              FROM fact_payments GROUP BY ALL)
ORDER BY total_amount DESC"""))(
    lambda s, d: V.payment_by_method(_w(s, d)))

register("branch_performance", O.with_full("""
SELECT branch_code, COUNT(*) AS loan_count, CAST(SUM(collected) AS DECIMAL(38,2)) AS total_collected,
       CAST(SUM(interest) AS DECIMAL(38,2)) AS total_interest_earned,
       CAST(SUM(rates) AS DOUBLE) / CAST(NULLIF(SUM(rated), 0) AS DOUBLE) AS avg_rate
FROM (SELECT branch_code, loan_sk, SUM(payment_amount) AS collected, SUM(interest_portion) AS interest,
             SUM(interest_rate) AS rates, COUNT(interest_rate) AS rated
      FROM fact_payments GROUP BY ALL)
GROUP BY ALL ORDER BY total_collected DESC"""))(
    lambda s, d: V.branch_performance(_w(s, d)))


# --------------------------------------------------- load products (A, H)
DIM_DATE_COLS = ("date_sk, full_date, day, month, month_name, quarter, year, week_of_year, day_of_week, "
                 "day_name, is_weekend, is_month_end")
register("calendar", O.with_full(f"""
SELECT {', '.join('dd.' + c.strip() for c in DIM_DATE_COLS.split(','))},
       COALESCE(p.n, 0) AS payments_on_day
FROM dim_date dd LEFT JOIN (SELECT date_sk, COUNT(*) AS n FROM fact_payments GROUP BY date_sk) p
  ON dd.date_sk = p.date_sk"""))(lambda s, d: V.calendar_activity(_w(s, d)))

STG_C = "customer_id, full_name, email, phone, city, country, segment, created_at"
STG_L = ("loan_id, customer_id, product_id, amount, interest_rate, tenure_months, status, disbursed_at, "
         "maturity_date, branch_code, created_at")
STG_P = ("payment_id, loan_id, amount, principal_portion, interest_portion, penalty_portion, payment_method, "
         "payment_date, created_at")
register("stage_customers", O.with_full(f"SELECT {STG_C} FROM stg_customers"))(
    lambda s, d: _w(s, d)["stg_customers"].select(*STG_C.split(", ")))
register("stage_loans", O.with_full(f"SELECT {STG_L} FROM stg_loans"))(
    lambda s, d: _w(s, d)["stg_loans"].select(*STG_L.split(", ")))
register("stage_payments", O.with_full(f"SELECT {STG_P} FROM stg_payments"))(
    lambda s, d: _w(s, d)["stg_payments"].select(*STG_P.split(", ")))

DIM_C = ("customer_sk, customer_id, full_name, email, phone, city, country, segment, effective_date, "
         "expiry_date, is_current")
DIM_L = ("loan_sk, loan_id, customer_id, product_id, amount, interest_rate, tenure_months, status, "
         "branch_code, disbursed_at, maturity_date")
register("dim_customer_keys", O.with_full(f"SELECT {DIM_C} FROM dim_customer"))(
    lambda s, d: _w(s, d)["dim_customer"].select(*DIM_C.split(", ")))
register("dim_loan_keys", O.with_full(f"SELECT {DIM_L} FROM dim_loan"))(
    lambda s, d: _w(s, d)["dim_loan"].select(*DIM_L.split(", ")))

register("dim_product_keys", O.with_full("""
SELECT p.product_sk, p.product_id, p.product_name, p.product_type, COALESCE(n.loans, 0) AS loan_count
FROM (SELECT CAST(row_number() OVER (ORDER BY product_id) AS BIGINT) AS product_sk, product_id, product_name,
             product_type FROM loan_products) p
LEFT JOIN (SELECT product_id, COUNT(*) AS loans FROM dim_loan GROUP BY product_id) n
  ON p.product_id = n.product_id"""))(lambda s, d: V.products_in_use(_w(s, d)))

register("payment_methods", O.with_full("""
SELECT m.method_sk, m.method_code, m.method_name, COALESCE(n.payments, 0) AS payment_count
FROM dim_payment_method m
LEFT JOIN (SELECT method_sk, COUNT(*) AS payments FROM fact_payments GROUP BY method_sk) n
  ON m.method_sk = n.method_sk"""))(lambda s, d: V.methods_in_use(_w(s, d)))

FP = ("payment_sk, payment_id, customer_sk, loan_sk, date_sk, method_sk, payment_amount, principal_portion, "
      "interest_portion, penalty_portion, loan_amount, interest_rate, customer_segment, loan_status, branch_code")
FL = ("loan_fact_sk, loan_id, customer_sk, loan_sk, disbursement_date_sk, maturity_date_sk, principal_amount, "
      "interest_rate, tenure_months, outstanding_balance, total_paid, payment_count, is_active, is_defaulted, "
      "is_repaid, customer_segment, branch_code")
register("fact_payments_first", O.with_full(f"SELECT {FP} FROM fact_payments"))(
    lambda s, d: _w(s, d)["fact_payments"].select(*FP.split(", ")))
register("fact_loans", O.with_full(f"SELECT {FL} FROM fact_loans"))(
    lambda s, d: _w(s, d)["fact_loans"].select(*FL.split(", ")))

# incremental scenario: run 1 on the first snapshot, run 2 on everything
register("fact_payments_increment", O.with_incremental(f"SELECT {FP} FROM r2_fact_payments"))(
    lambda s, d: _inc(s, d)["fact_payments"].select(*FP.split(", ")))
register("fact_loans_second_run", O.with_incremental(
    f"SELECT {FL}, etl_loaded_at FROM r2_fact_loans"))(
    lambda s, d: _inc(s, d)["fact_loans"].select(*FL.split(", "), "etl_loaded_at"))
register("dim_loan_second_run", O.with_incremental(f"SELECT {DIM_L} FROM r2_dim_loan"))(
    lambda s, d: _inc(s, d)["dim_loan"].select(*DIM_L.split(", ")))
register("late_dimension_pending", O.with_incremental("""
SELECT sp.payment_id, sp.loan_id, sp.payment_date,
       sp.loan_id IN (SELECT loan_id FROM r1_stg_loans) AS loan_seen_in_run1,
       sp.payment_id IN (SELECT payment_id FROM r2_fact_payments) AS loaded_in_run2
FROM r1_stg_payments sp
WHERE sp.payment_id NOT IN (SELECT payment_id FROM r1_fact_payments)"""))(
    lambda s, d: V.late_pending(WH.built(s, d, "incremental")))

# ----------------------------------------------------- guide queries K8-K18
register("warehouse_counts", O.with_full("""
SELECT 'dim_customer' AS table_name, COUNT(*) AS row_count FROM dim_customer
UNION ALL SELECT 'dim_loan', COUNT(*) FROM dim_loan
UNION ALL SELECT 'dim_date', COUNT(*) FROM dim_date
UNION ALL SELECT 'dim_payment_method', COUNT(*) FROM dim_payment_method
UNION ALL SELECT 'fact_payments', COUNT(*) FROM fact_payments
UNION ALL SELECT 'fact_loans', COUNT(*) FROM fact_loans"""))(lambda s, d: V.warehouse_counts(_w(s, d)))

register("totals", O.with_full("""
SELECT (SELECT COUNT(*) FROM fact_loans) AS total_loans,
       (SELECT CAST(SUM(payment_amount) AS DECIMAL(38,2)) FROM fact_payments) AS total_revenue"""))(
    lambda s, d: V.totals(_w(s, d)))

register("status_totals", O.with_full("""
SELECT loan_status, COUNT(*) AS payment_rows, CAST(SUM(loan_amount) AS DECIMAL(38,2)) AS total_loan_amount
FROM fact_payments GROUP BY loan_status"""))(lambda s, d: V.status_totals(_w(s, d)))

register("revenue_by_segment", O.with_full("""
SELECT customer_segment, CAST(SUM(payment_amount) AS DECIMAL(38,2)) AS total_revenue
FROM fact_payments GROUP BY customer_segment"""))(lambda s, d: V.revenue_by_segment(_w(s, d)))

register("revenue_month_branch", O.with_full("""
SELECT dd.year, dd.month, fp.branch_code, CAST(SUM(fp.payment_amount) AS DECIMAL(38,2)) AS total_revenue,
       COUNT(*) AS payment_count
FROM fact_payments fp JOIN dim_date dd ON fp.date_sk = dd.date_sk
WHERE dd.full_date > (SELECT CAST(max(d2.full_date) - INTERVAL 36 MONTH AS DATE)
                      FROM fact_payments f2 JOIN dim_date d2 ON f2.date_sk = d2.date_sk)
GROUP BY dd.year, dd.month, fp.branch_code"""))(lambda s, d: V.revenue_month_branch(_w(s, d)))

register("disbursed_month", O.with_full("""
SELECT dd.year, dd.month, COUNT(*) AS loans_disbursed,
       CAST(SUM(fl.principal_amount) AS DECIMAL(38,2)) AS total_disbursed
FROM fact_loans fl JOIN dim_date dd ON fl.disbursement_date_sk = dd.date_sk
WHERE dd.full_date > (SELECT CAST(max(d2.full_date) - INTERVAL 24 MONTH AS DATE)
                      FROM fact_loans f2 JOIN dim_date d2 ON f2.disbursement_date_sk = d2.date_sk)
GROUP BY dd.year, dd.month"""))(lambda s, d: V.disbursed_by_month(_w(s, d)))

register("default_rate_segment", O.with_full("""
SELECT customer_segment, COUNT(*) AS loan_count,
       CAST(SUM(CAST(is_defaulted AS INTEGER)) AS BIGINT) AS defaulted,
       CAST(SUM(CAST(is_defaulted AS INTEGER)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS default_rate
FROM fact_loans GROUP BY customer_segment"""))(lambda s, d: V.default_rate_by_segment(_w(s, d)))

register("interest_branch", O.with_full("""
SELECT branch_code, CAST(SUM(interest_portion) AS DECIMAL(38,2)) AS total_interest_earned
FROM fact_payments GROUP BY branch_code"""))(lambda s, d: V.interest_by_branch(_w(s, d)))

# ------------------------------------------------ operational views K1 K2
register("active_loans", O.with_source("""
SELECT loan_id, holder.full_name AS customer_name, holder.email, holder.segment,
       (SELECT any_value(product_name) FROM loan_products WHERE product_id = open_loan.product_id) AS product_name,
       amount, interest_rate, tenure_months, outstanding_balance, status, disbursed_at, maturity_date
FROM (FROM src_loans WHERE status = 'active') AS open_loan
JOIN src_customers AS holder USING (customer_id)"""))(lambda s, d: V.active_loans(_op(s, d)))

# the joined rows themselves: a loan's amount stands beside each of its payments
CPS = """
SELECT h.customer_id, any_value(h.full_name) AS full_name, any_value(h.segment) AS segment, COUNT(DISTINCT loan.loan_id) AS total_loans,
       CAST(SUM(loan.amount) AS DECIMAL(38,2)) AS total_loan_amount, COUNT(pay.payment_id) AS total_payments,
       CAST(ifnull(SUM(pay.amount), 0) AS DECIMAL(38,2)) AS total_paid, MAX(pay.payment_date) AS last_payment_date
FROM src_payments pay RIGHT JOIN src_loans loan USING (loan_id) RIGHT JOIN src_customers h USING (customer_id)
GROUP BY h.customer_id"""
register("customer_payment_summary", O.with_source(CPS))(
    lambda s, d: V.customer_payment_summary(_op(s, d), fan_out=True))
register("customer_payment_summary_exact", O.with_source("""
SELECT c.customer_id, c.full_name, c.segment,
       COUNT(l.loan_id) AS total_loans,
       CAST(SUM(l.amount) AS DECIMAL(38,2)) AS total_loan_amount,
       CAST(COALESCE(SUM(pl.n), 0) AS BIGINT) AS total_payments,
       CAST(COALESCE(SUM(pl.paid), 0) AS DECIMAL(38,2)) AS total_paid,
       MAX(pl.last_date) AS last_payment_date
FROM src_customers c
LEFT JOIN src_loans l ON l.customer_id = c.customer_id
LEFT JOIN (SELECT loan_id, COUNT(*) AS n, SUM(amount) AS paid, MAX(payment_date) AS last_date
           FROM src_payments GROUP BY loan_id) pl ON pl.loan_id = l.loan_id
GROUP BY c.customer_id, c.full_name, c.segment"""))(
    lambda s, d: V.customer_payment_summary(_op(s, d), fan_out=False))

register("loan_payment_counts", O.with_source("""
SELECT l.loan_id, l.amount, l.outstanding_balance, l.status,
       (SELECT COUNT(*) FROM src_payments p WHERE p.loan_id = l.loan_id) AS payment_count
FROM src_loans l"""))(lambda s, d: V.loan_payment_counts(_op(s, d)))

register("loan_points", O.with_source("""
SELECT p.payment_id, p.loan_id, p.amount, p.payment_method, p.payment_date
FROM src_payments p
WHERE p.payment_method = 'cash' AND p.amount > 0
  AND EXISTS (SELECT 1 FROM src_loans l WHERE l.loan_id = p.loan_id AND l.status IN ('active', 'defaulted'))
ORDER BY p.loan_id, p.payment_id"""))(lambda s, d: V.loan_points(_op(s, d)))


# ------------------------------------------------------- quality J1-J8, G6
def _dq_tables(spark, d):
    raw = {t: TD.read_table(spark, d, t) for t in ("orders", "lineitem")}
    return {**raw, **_op(spark, d), **_w(spark, d), "audit_log": _log(spark, d)}


def _spoiled(spark, d, rules):
    """The rules' tables with faults; parents of foreign keys stay sound."""
    sound = _dq_tables(spark, d)
    return DQ.summary(rules, {t: SP.spoil(t, sound[t], rules) for t in dict.fromkeys(r.table for r in rules)}, parents=sound)


for _name, _rules in (("dq_not_null", DQ.NOT_NULL), ("dq_unique", DQ.UNIQUE), ("dq_domain", DQ.DOMAIN),
                      ("dq_fk", DQ.FOREIGN_KEY), ("dq_range", DQ.RANGE), ("dq_length", DQ.LENGTH),
                      ("dq_precision", DQ.PRECISION)):
    register(_name, O.rules_summary_sql(_rules))(
        (lambda rules: lambda s, d: DQ.summary(rules, _dq_tables(s, d)))(_rules))
    register(f"{_name}_faults", O.spoiled_summary_sql(_rules))(
        (lambda rules: lambda s, d: _spoiled(s, d, rules).select("rule_id", "violations"))(_rules))

# A4: typed rows and rejects of payments that come as text, some of them spoiled
def _text_payments(spark, d):
    from ..sources import schemas as S
    k, p = F.col("payment_id"), _op(spark, d)["payments"]
    text = {c: F.col(c).cast("string") for c in S.PAYMENTS.names}
    text["amount"] = F.when(k % 41 == 0, F.concat(text["amount"], F.lit("x"))).otherwise(text["amount"])
    text["payment_date"] = F.when(k % 43 == 0, F.lit("2030-02-30")).otherwise(text["payment_date"])
    text["loan_id"] = F.when(k % 47 == 0, F.lit(None)).otherwise(text["loan_id"])
    text["payment_method"] = F.when(k % 53 == 0, F.lit("m" * 31)).otherwise(text["payment_method"])
    return p.select(*[v.alias(c) for c, v in text.items()])


def _ingest_rejects(spark, d):
    from ..sources import readers as R
    from ..sources import schemas as S
    good, bad = R.ingest_into(_text_payments(spark, d), S.PAYMENTS, _folder(spark, "ingest"), S.PAYMENT_DEFAULTS, S.PAYMENT_LENGTHS)
    rows = bad.select(F.get_json_object("raw", "$.payment_id").cast("long").alias("payment_id"), F.concat_ws(", ", "reasons").alias("reasons"))
    return rows.unionByName(good.select("payment_id", F.lit("").alias("reasons")))


register("ingest_rejects", O.with_source("""
SELECT payment_id, concat_ws(', ', CASE WHEN payment_id % 47 = 0 THEN 'loan_id: missing' END,
       CASE WHEN payment_id % 41 = 0 THEN 'amount: not decimal(14,2)' END,
       CASE WHEN payment_id % 53 = 0 THEN 'payment_method: longer than 30' END,
       CASE WHEN payment_id % 43 = 0 THEN 'payment_date: not date' END) AS reasons
FROM src_payments"""))(_ingest_rejects)

# A1-A3: splits of a parallel extract by the quantiles of a sparse, unevenly spaced key, null keys included
EXTRACT_SPLITS = 8


def _extract_splits(spark, d):
    from ..sources import readers as R
    k = F.col("payment_id")
    # powers of the id crowd the low end, and go beyond a long; some keys are null
    keys = _op(spark, d)["payments"].select("payment_id", F.when(k % 100 == 99, F.lit(None)).otherwise(F.rint(F.pow(k / 1000, 3))).alias("key"))
    predicates = R.split_predicates("key", R.split_points(keys, "key", EXTRACT_SPLITS))
    hits = keys.select("key", *[F.when(F.expr(p), 1).otherwise(0).alias(f"s{i}") for i, p in enumerate(predicates)])
    in_one = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(predicates))])
    sizes = hits.agg(F.count("*").alias("rows"), F.sum((in_one == 1).cast("long")).alias("in_one_split"), F.count("key").alias("keys"),
                     *[F.sum(F.when(F.col("key").isNotNull(), F.col(f"s{i}")).otherwise(0)).alias(f"n{i}") for i in range(len(predicates))])
    share = F.col("keys") / EXTRACT_SPLITS
    return sizes.select(F.lit(len(predicates)).alias("splits"), "rows", "in_one_split",
                        reduce(lambda a, b: a & b, [F.abs(F.col(f"n{i}") / share - 1) <= 0.1 for i in range(len(predicates))]).alias("even"))


register("extract_splits", O.with_source(
    f"SELECT CAST({EXTRACT_SPLITS} AS INTEGER) AS splits, COUNT(*) AS rows, COUNT(*) AS in_one_split, TRUE AS even FROM src_payments"))(_extract_splits)

# I19: defaults of columns that a source leaves out or null
def _stage_defaults(spark, d):
    from ..sources import readers as R
    from ..sources import schemas as S
    bare = _op(spark, d)["customers"].drop("country", "is_active").withColumn(
        "segment", F.when(F.col("customer_id") % 5 != 0, F.col("segment")))
    return R.conform(bare, S.CUSTOMERS, S.CUSTOMER_DEFAULTS).select("customer_id", "city", "country", "segment", "is_active")


register("stage_defaults", O.with_source("""
SELECT customer_id, city, 'Kenya' AS country, ifnull(CASE WHEN customer_id % 5 <> 0 THEN segment END, 'retail') AS segment, TRUE AS is_active
FROM src_customers"""))(_stage_defaults)

register("dq_populated", O.with_full("\nUNION ALL\n".join(
    f"SELECT '{r.table}' AS table_name, COUNT(*) AS row_count, CAST({r.arg} AS BIGINT) AS min_rows, "
    f"COUNT(*) >= {r.arg} AS passed FROM {O._t(r.table)}" for r in DQ.POPULATED)))(
    lambda s, d: DQ.populated_report(DQ.POPULATED, _dq_tables(s, d)))

register("dq_restrict", O.with_source("""
SELECT c.customer_id, COUNT(*) AS child_rows
FROM src_customers c JOIN src_loans l ON l.customer_id = c.customer_id
WHERE NOT c.is_active GROUP BY c.customer_id"""))(
    lambda s, d: DQ.restrict_deletes(_op(s, d)["customers"].where(~F.col("is_active")),
                                     _op(s, d)["loans"], "customer_id"))

BATCH_RULES = [r for r in DQ.DOMAIN + DQ.RANGE + DQ.FOREIGN_KEY + DQ.NOT_NULL if r.table == "payments"]
register("atomic_batch_rejected", O.with_source("""
SELECT p.payment_date, COUNT(*) AS batch_rows,
       CAST(SUM(CASE WHEN (p.payment_method IS NOT NULL AND p.payment_method NOT IN
                           ('mpesa', 'bank_transfer', 'cash', 'cheque', 'online'))
                       OR (p.amount IS NOT NULL AND NOT (p.amount > 0))
                       OR (p.loan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src_loans l WHERE l.loan_id = p.loan_id))
                       OR p.payment_id IS NULL OR p.loan_id IS NULL OR p.amount IS NULL OR p.payment_date IS NULL
                     THEN 1 ELSE 0 END) AS BIGINT) AS rejected_rows,
       SUM(CASE WHEN (p.payment_method IS NOT NULL AND p.payment_method NOT IN
                           ('mpesa', 'bank_transfer', 'cash', 'cheque', 'online'))
                       OR (p.amount IS NOT NULL AND NOT (p.amount > 0))
                       OR (p.loan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src_loans l WHERE l.loan_id = p.loan_id))
                       OR p.payment_id IS NULL OR p.loan_id IS NULL OR p.amount IS NULL OR p.payment_date IS NULL
                THEN 1 ELSE 0 END) = 0 AS accepted
FROM src_payments p GROUP BY p.payment_date"""))(
    lambda s, d: DQ.batch_gate(_op(s, d)["payments"], BATCH_RULES, ["payment_date"], _op(s, d), "payments"))


register("accepted_payments", O.with_source("""
SELECT payment_id, payment_date FROM src_payments WHERE payment_date NOT IN (
  SELECT payment_date FROM src_payments WHERE ifnull(payment_method, 'cash') NOT IN ('mpesa', 'bank_transfer', 'cash', 'cheque', 'online')
     OR amount <= 0 OR loan_id NOT IN (SELECT loan_id FROM src_loans))"""))(
    lambda s, d: DQ.accepted_rows(_op(s, d)["payments"], DQ.batch_gate(
        _op(s, d)["payments"], BATCH_RULES, ["payment_date"], _op(s, d), "payments"), ["payment_date"]).select("payment_id", "payment_date"))


# ------------------------------------------------- small operators on the tables
register("dim_customer_second_run", O.with_incremental(f"SELECT {DIM_C} FROM r2_dim_customer"))(
    lambda s, d: _inc(s, d)["dim_customer"].select(*DIM_C.split(", ")))

# H14: keyed update and delete as new versions
register("loans_updated_deleted", O.with_source("""
SELECT loan_id, customer_id, CASE WHEN status = 'defaulted' THEN 'COLLECT' ELSE branch_code END AS branch_code, status
FROM src_loans SEMI JOIN (SELECT customer_id FROM src_customers WHERE is_active) USING (customer_id)"""))(
    lambda s, d: UP.delete_keys(
        UP.update_where(_op(s, d)["loans"], F.col("status") == "defaulted", {"branch_code": F.lit("COLLECT")}),
        _op(s, d)["customers"].where("NOT is_active"), "customer_id").select("loan_id", "customer_id", "branch_code", "status"))

# K20: how often a loan was paid the same amount
register("payments_by_loan_amount", O.with_source(
    "SELECT loan_id, amount, COUNT(*) AS payments FROM src_payments GROUP BY ALL"))(
    lambda s, d: _op(s, d)["payments"].groupBy("loan_id", "amount").agg(F.count("*").alias("payments")))

# newest first, open ends last
register("loans_by_maturity", O.with_source("""
SELECT loan_id, status, CASE WHEN status = 'active' THEN maturity_date END AS due FROM src_loans
ORDER BY due DESC NULLS LAST, loan_id LIMIT 50"""))(
    lambda s, d: _op(s, d)["loans"].select("loan_id", "status", F.when(F.col("status") == "active", F.col("maturity_date")).alias("due"))
    .orderBy(F.col("due").desc_nulls_last(), "loan_id").limit(50))

# I12, I15, I18: epoch seconds, cut text, literals with an offset
register("event_clock", """
SELECT event_id, epoch_us(ts) / 1000000 AS epoch, substr(event_type, 1, 3) AS kind, ts - INTERVAL 3 HOUR AS utc
FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)""")(
    lambda s, d: TD.read_table(s, d, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")).select(
        "event_id", EX.epoch_seconds("ts").alias("epoch"), EX.truncate_text("event_type", 3).alias("kind"),
        EX.utc_from_offset_text(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+03"))).alias("utc")))


# ----------------------------------------------- changes G1-G4 G8, posting
LOAN_DIFF_COLS = ["customer_id", "product_id", "amount", "interest_rate", "tenure_months", "status",
                  "disbursed_at", "maturity_date", "outstanding_balance", "loan_officer", "branch_code",
                  "created_at"]


def _loan_changes(spark, d):
    src = _op(spark, d)
    old = TD.first_snapshot(src)["loans"].select("loan_id", *LOAN_DIFF_COLS)
    new = TD.second_snapshot(src)["loans"].select("loan_id", *LOAN_DIFF_COLS)
    log = CH.diff(old, new, "loan_id", LOAN_DIFF_COLS)
    return log.select("table_name", "operation", "record_id", "changed_columns",
                      F.get_json_object("old_values", "$.status").alias("old_status"),
                      F.get_json_object("new_values", "$.status").alias("new_status"))


_distinct = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in LOAN_DIFF_COLS)
_changed = ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in LOAN_DIFF_COLS)
register("loan_changes", O.with_incremental(f"""
SELECT 'loans' AS table_name,
       CASE WHEN o.loan_id IS NULL THEN 'INSERT' WHEN n.loan_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       COALESCE(n.loan_id, o.loan_id) AS record_id,
       CASE WHEN o.loan_id IS NOT NULL AND n.loan_id IS NOT NULL THEN concat_ws(',', {_changed}) END
         AS changed_columns,
       o.status AS old_status, n.status AS new_status
FROM s1_loans o FULL OUTER JOIN s2_loans n ON o.loan_id = n.loan_id
WHERE o.loan_id IS NULL OR n.loan_id IS NULL OR {_distinct}"""))(_loan_changes)

# the same changes, looked for only in key ranges whose digests differ
def _ranged_loans(spark, d):
    from ..operators import digests as D
    from ..sources import ranged as RG
    src, store = _op(spark, d), TableStore(spark, _folder(spark, "ranged"))
    versions = [TD.first_snapshot(src)["loans"], TD.second_snapshot(src)["loans"]]
    width = D.width_for(versions[1], "loan_id", 4096)
    for v in versions:
        RG.write(store, {"loans": (v.select("loan_id", *LOAN_DIFF_COLS), "loan_id")}, width)
    return store


def _changes_by_digest(spark, d):
    from ..sources import ranged as RG
    return RG.diff(_once(_ranged_loans)(spark, d), "loans", 1, 2, LOAN_DIFF_COLS).select(
        "table_name", "operation", "record_id", "changed_columns", F.get_json_object("old_values", "$.status").alias("old_status"),
        F.get_json_object("new_values", "$.status").alias("new_status"))


register("loan_changes_by_digest", REGISTRY["loan_changes"][1])(_changes_by_digest)


# the loans' audit log over two versions, the second without some loans, stored as an appended table
def _loan_audit(spark, d):
    src, root = _op(spark, d), _folder(spark, "audit")
    cols = ["loan_id", *LOAN_DIFF_COLS]
    one = TD.first_snapshot(src)["loans"].select(*cols)
    two = TD.second_snapshot(src)["loans"].select(*cols).where("loan_id % 17 != 0")
    t = [F.lit(x).cast("timestamp_ntz") for x in (WH.FIXED_RUN_TS, WH.SECOND_RUN_TS)]
    store = TableStore(spark, root)
    e = store.write_table("audit_log", CH.audit_log(None, one, "loan_id", t[0], "load", 0, LOAN_DIFF_COLS), 1, key_col="log_id")
    store.commit([e], 1)
    log = CH.audit_log(one, two, "loan_id", t[1], "load", e["max_key"] or 0, LOAN_DIFF_COLS)
    store.commit([store.write_table("audit_log", log, 2, append_to=e, key_col="log_id")], 2)
    return store


def _loan_state(spark, d, at):
    log = _once(_loan_audit)(spark, d).read("audit_log")
    schema = _op(spark, d)["loans"].select("loan_id", *LOAN_DIFF_COLS).schema
    return CH.state_from_images(log, F.lit(at).cast("timestamp_ntz"), schema)


_COLS = ", ".join(["loan_id", *LOAN_DIFF_COLS])
register("loan_audit_log", O.with_incremental(f"""
, two AS (SELECT {_COLS} FROM s2_loans WHERE loan_id % 17 != 0),
changes AS (SELECT coalesce(n.loan_id, o.loan_id) AS record_id,
              CASE WHEN o.loan_id IS NULL THEN 'INSERT' WHEN n.loan_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
              o.status AS old_status, n.status AS new_status
            FROM s1_loans o FULL JOIN two n ON o.loan_id = n.loan_id
            WHERE o.loan_id IS NULL OR n.loan_id IS NULL OR {_distinct})
SELECT row_number() OVER (ORDER BY loan_id) AS log_id, 'loans' AS table_name, 'INSERT' AS operation, loan_id AS record_id,
       'load' AS changed_by, {O.RUN1} AS change_time, NULL::VARCHAR AS old_status, status AS new_status FROM s1_loans
UNION ALL
SELECT (SELECT COUNT(*) FROM s1_loans) + row_number() OVER (ORDER BY record_id), 'loans', operation, record_id, 'load', {O.RUN2},
       old_status, new_status FROM changes"""))(
    lambda s, d: _once(_loan_audit)(s, d).read("audit_log").select(
        "log_id", "table_name", "operation", "record_id", "changed_by", "change_time",
        F.get_json_object("old_values", "$.status").alias("old_status"), F.get_json_object("new_values", "$.status").alias("new_status")))
register("loan_state_as_of_first", O.with_incremental(f"SELECT {_COLS} FROM s1_loans"))(lambda s, d: _loan_state(s, d, WH.FIXED_RUN_TS))
register("loan_state_as_of_second", O.with_incremental(f"SELECT {_COLS} FROM s2_loans WHERE loan_id % 17 != 0"))(
    lambda s, d: _loan_state(s, d, WH.SECOND_RUN_TS))
register("loan_changes_latest", O.with_incremental(f"""
, two AS (SELECT {_COLS} FROM s2_loans WHERE loan_id % 17 != 0),
changes AS (SELECT coalesce(n.loan_id, o.loan_id) AS record_id, o.amount AS old_amount, n.amount AS new_amount
            FROM s1_loans o FULL JOIN two n ON o.loan_id = n.loan_id
            WHERE o.loan_id IS NULL OR n.loan_id IS NULL OR {_distinct})
SELECT (SELECT COUNT(*) FROM s1_loans) + row_number() OVER (ORDER BY record_id) AS log_id, record_id, old_amount, new_amount
FROM changes ORDER BY log_id DESC LIMIT 20"""))(
    lambda s, d: CH.latest_changes(_once(_loan_audit)(s, d).read("audit_log"), 20).select(
        "log_id", "record_id", F.get_json_object("old_values", "$.amount").cast("decimal(14,2)").alias("old_amount"),
        F.get_json_object("new_values", "$.amount").cast("decimal(14,2)").alias("new_amount")))

# the same log with VARIANT images
def _variant_audit(spark, d):
    store = TableStore(spark, _folder(spark, "audit_variant"))
    store.write_version({"audit_log": CH.as_variant(_once(_loan_audit)(spark, d).read("audit_log"))})
    return store


register("loan_audit_log_variant", REGISTRY["loan_audit_log"][1])(
    lambda s, d: _once(_variant_audit)(s, d).read("audit_log").select(
        "log_id", "table_name", "operation", "record_id", "changed_by", "change_time",
        CH.image_field("old_values", "status").alias("old_status"), CH.image_field("new_values", "status").alias("new_status")))
register("loan_changes_latest_variant", REGISTRY["loan_changes_latest"][1])(
    lambda s, d: CH.latest_changes(_once(_variant_audit)(s, d).read("audit_log"), 20).select(
        "log_id", "record_id", CH.image_field("old_values", "amount", "decimal(14,2)").alias("old_amount"),
        CH.image_field("new_values", "amount", "decimal(14,2)").alias("new_amount")))
register("loan_state_as_of_variant", REGISTRY["loan_state_as_of_second"][1])(
    lambda s, d: CH.state_from_variant(_once(_variant_audit)(s, d).read("audit_log"), F.lit(WH.SECOND_RUN_TS).cast("timestamp_ntz"),
                                       _op(s, d)["loans"].select("loan_id", *LOAN_DIFF_COLS).schema))

EVENT_ATTRS = ["event_type", "value", "props", "change_time"]


def _log(spark, d):
    return CH.events_as_change_log(TD.read_table(spark, d, "events"))


def _apply_changes(spark, d):
    log = _log(spark, d)
    at = F.lit(TD.STATE_AS_OF).cast("timestamp_ntz")
    base = CH.state_as_of(log, at, "record_id", ["event_type", "value", "props"])
    later = log.where(F.col("change_time") > at)
    return CH.apply_changes(base, later, "record_id", EVENT_ATTRS)


_LATEST = """
SELECT user_id AS record_id, event_type, value, props, ts AS change_time
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events {where}) t
WHERE rn = 1 AND event_type <> 'error'"""
register("apply_changes", _LATEST.format(where=""))(_apply_changes)
register("state_as_of", _LATEST.format(where=f"WHERE ts <= TIMESTAMP '{TD.STATE_AS_OF}'"))(
    lambda s, d: CH.state_as_of(_log(s, d), F.lit(TD.STATE_AS_OF).cast("timestamp_ntz"), "record_id",
                                ["event_type", "value", "props"]))
register("changes_latest", """
SELECT event_id AS log_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
       ELSE 'UPDATE' END AS operation, user_id AS record_id, ts AS change_time, value
FROM events ORDER BY event_id DESC LIMIT 20""")(
    lambda s, d: CH.latest_changes(_log(s, d), 20).select("log_id", "operation", "record_id", "change_time",
                                                          "value"))

POST_SQL = """
x AS (SELECT p.payment_id, p.loan_id, p.payment_date, p.amount, l.outstanding_balance AS bal,
             COALESCE(SUM(p.amount) OVER (PARTITION BY p.loan_id ORDER BY p.payment_date, p.payment_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM src_payments p JOIN src_loans l ON l.loan_id = p.loan_id),
y AS (SELECT *, greatest(bal - prev, 0) AS before FROM x),
z AS (SELECT *, least(amount, before) AS applied FROM y)"""
register("post_payments", O.with_source("," + POST_SQL + """
SELECT payment_id, loan_id, payment_date, amount, CAST(applied AS DECIMAL(14,2)) AS applied,
       CAST(before AS DECIMAL(14,2)) AS balance_before,
       CAST(round(applied * 0.75, 2) AS DECIMAL(14,2)) AS principal_portion,
       CAST(round(applied * 0.25, 2) AS DECIMAL(14,2)) AS interest_portion,
       CAST(before - applied AS DECIMAL(14,2)) AS balance_after
FROM z WHERE applied > 0"""))(lambda s, d: PO.post_payments(_op(s, d)["loans"], _op(s, d)["payments"])[0])
register("payment_rejects", O.with_source("," + POST_SQL + """
SELECT payment_id, loan_id, amount, 'nothing_to_apply' AS reason FROM z WHERE applied <= 0
UNION ALL
SELECT payment_id, loan_id, amount, 'unknown_loan' FROM src_payments ANTI JOIN src_loans USING (loan_id)"""))(
    lambda s, d: PO.post_payments(_op(s, d)["loans"], _op(s, d)["payments"])[2])
register("balance_deltas", O.with_source("," + POST_SQL + """,
d AS (SELECT loan_id, SUM(applied) AS delta, COUNT(*) AS n FROM z WHERE applied > 0 GROUP BY loan_id)
SELECT l.loan_id, CAST(l.outstanding_balance - COALESCE(d.delta, 0) AS DECIMAL(14,2)) AS outstanding_balance,
       CASE WHEN d.loan_id IS NOT NULL AND l.outstanding_balance - d.delta <= 0 THEN 'repaid' ELSE l.status END
         AS status,
       COALESCE(d.n, 0) AS payments_posted
FROM src_loans l LEFT JOIN d ON l.loan_id = d.loan_id"""))(
    lambda s, d: PO.post_payments(_op(s, d)["loans"], _op(s, d)["payments"])[1]
    .select("loan_id", "outstanding_balance", "status", "payments_posted"))

# the state at times before, on and after a mark, and after late rows: last mark and tail
MARKED_AT = ("2024-01-03 00:00:00", "2024-01-08 00:00:00", "2024-01-08 12:00:00", "2024-01-21 00:00:00")


def _marked_log(spark, d):
    from ..sources.changelog import ChangeLog
    log = ChangeLog(TableStore(spark, f"{_folder(spark, 'marks')}/log"), "record_id", EVENT_ATTRS, every=1 << 62)
    rows, late = _log(spark, d), F.col("log_id") % 29 == 0
    step = lambda a, b: rows.where(~late & (F.col("change_time") > F.lit(a).cast("timestamp_ntz"))
                                   & (F.col("change_time") <= F.lit(b).cast("timestamp_ntz")))
    days = ["1970-01-01 00:00:00", "2024-01-04 00:00:00", MARKED_AT[1], "2024-01-15 00:00:00", "9999-01-01 00:00:00"]
    for i, (a, b) in enumerate(zip(days, days[1:])):
        log.append(step(a, b))
        if i == 1:
            log.mark()
    log.append(rows.where(late))                            # rows of all times that come last
    return log


def _state_marked(spark, d):
    log = _once(_marked_log)(spark, d)
    parts = [log.as_of(t).select(F.lit(t).alias("at"), "record_id", *EVENT_ATTRS) for t in MARKED_AT]
    return reduce(DataFrame.unionByName, parts)


register("state_as_of_marked", " UNION ALL ".join(
    f"SELECT '{t}' AS at, * FROM (" + _LATEST.format(where=f"WHERE ts <= TIMESTAMP '{t}'") + ")" for t in MARKED_AT))(_state_marked)


# ------------------------------------------------------------------ SCD2
SCD_TRACKED = ["full_name", "email", "phone", "city", "country", "segment"]


def _scd2(spark, d):
    src = _op(spark, d)
    c1 = src["customers"].where("is_active").select("customer_id", *SCD_TRACKED)
    c2 = TD.customers_second_snapshot(src["customers"], src["loans"]).where("is_active") \
        .select("customer_id", *SCD_TRACKED)
    v1 = UP.scd2(None, c1, "customer_id", SCD_TRACKED, "customer_sk", F.lit("2030-01-01"))
    v2 = UP.scd2(v1, c2, "customer_id", SCD_TRACKED, "customer_sk", F.lit("2030-01-02"))
    return v2.select("customer_sk", "customer_id", "segment", "effective_date", "expiry_date", "is_current")


_scd_distinct = " OR ".join(f"v1.{c} IS DISTINCT FROM c2.{c}" for c in SCD_TRACKED)
register("dim_customer_scd2", O.with_source(f""",
c1 AS (SELECT customer_id, {', '.join(SCD_TRACKED)} FROM src_customers WHERE is_active),
cnt AS (SELECT customer_id, COUNT(*) AS n FROM src_loans GROUP BY customer_id),
c2 AS (SELECT c.customer_id, {', '.join('c.' + x for x in SCD_TRACKED if x != 'segment')},
              CASE WHEN COALESCE(cnt.n, 0) >= {TD.SEGMENT_UPGRADE_LOANS} THEN 'corporate' ELSE c.segment END
                AS segment
       FROM c1 c LEFT JOIN cnt ON c.customer_id = cnt.customer_id),
v1 AS (SELECT CAST(row_number() OVER (ORDER BY customer_id) AS BIGINT) AS customer_sk, * FROM c1),
chg AS (SELECT v1.customer_id FROM v1 JOIN c2 ON v1.customer_id = c2.customer_id WHERE {_scd_distinct})
SELECT customer_sk, customer_id, segment, DATE '2030-01-01' AS effective_date, CAST(NULL AS DATE) AS expiry_date,
       TRUE AS is_current FROM v1 WHERE customer_id NOT IN (SELECT customer_id FROM chg)
UNION ALL
SELECT customer_sk, customer_id, segment, DATE '2030-01-01', DATE '2030-01-01', FALSE
FROM v1 WHERE customer_id IN (SELECT customer_id FROM chg)
UNION ALL
SELECT (SELECT max(customer_sk) FROM v1) + row_number() OVER (ORDER BY customer_id), customer_id, segment,
       DATE '2030-01-02', CAST(NULL AS DATE), TRUE
FROM c2 WHERE customer_id IN (SELECT customer_id FROM chg)"""))(_scd2)


# -------------------------------------------------------------- streaming


def _payment_stream_store(spark, d):
    """Two micro-batches (payments before / after the cut) through the
    Structured Streaming load, once per session."""
    k = (spark.sparkContext.applicationId, d)
    if k in _STREAMS:
        return _STREAMS[k]
    import uuid
    from ..session import scratch_path
    from ..sources import schemas as S
    from ..sources.store import TableStore
    from ..streaming import microbatch as MB
    root = scratch_path(spark, "stream", uuid.uuid4().hex)
    src = _op(spark, d)
    cut = F.lit(TD.SNAPSHOT_CUTOFF).cast("date")
    pays = src["payments"]
    wh = TableStore(spark, f"{root}/warehouse")
    for i, part in enumerate((pays.where(F.col("payment_date") < cut), pays.where(F.col("payment_date") >= cut))):
        MB.land(part, f"{root}/landing", f"part={i}")
        MB.payment_stream(spark, f"{root}/landing", S.PAYMENTS, wh,
                          {k: v for k, v in src.items() if k != "payments"}, f"{root}/_checkpoint",
                          run_ts_of=lambda b: [WH.FIXED_RUN_TS, WH.SECOND_RUN_TS][min(b, 1)]).awaitTermination()
    _STREAMS[k] = wh
    return wh


def _stream_fact_payments(spark, d):
    return _payment_stream_store(spark, d).read("fact_payments").select(*FP.split(", "))


_STREAM_SQL = ("WITH " + O.SOURCE + "," + O.SNAPSHOTS + "," +
               O.run_ctes("m1", "src_loans", "s1_payments", O.RUN1, None) + "," +
               O.run_ctes("m2", "src_loans", "src_payments", O.RUN2, "m1"))
register("stream_fact_payments", _STREAM_SQL + f"\nSELECT {FP} FROM m2_fact_payments")(_stream_fact_payments)
register("stream_fact_loans", _STREAM_SQL + f"\nSELECT {FL}, etl_loaded_at FROM m2_fact_loans")(
    lambda s, d: _payment_stream_store(s, d).read("fact_loans").select(*FL.split(", "), "etl_loaded_at"))


def _stream_changes(spark, d, late_first=False):
    import uuid
    from ..session import scratch_path
    from ..sources.store import TableStore
    from ..streaming import microbatch as MB
    root = scratch_path(spark, "changes", uuid.uuid4().hex)
    ev = TD.read_table(spark, d, "events")
    at = F.lit(TD.STATE_AS_OF).cast("timestamp_ntz")
    state = TableStore(spark, f"{root}/state")
    parts = [ev.where(F.col("ts") <= at), ev.where(F.col("ts") > at)]
    for i, part in enumerate(reversed(parts) if late_first else parts):
        MB.land(part, f"{root}/landing", f"part={i}")
        MB.change_stream(spark, f"{root}/landing", ev.schema, state, "record_id", EVENT_ATTRS,
                         CH.events_as_change_log, f"{root}/_checkpoint").awaitTermination()
    return MB.read_state(state)


register("stream_changes", _LATEST.format(where=""))(_stream_changes)
# the newer half comes first: older changes must not win, deleted keys not come back
register("stream_changes_out_of_order", _LATEST.format(where=""))(lambda s, d: _stream_changes(s, d, True))


# ------------------------------------------ loads that are interrupted, repeated or mixed
def _halves(payments):
    """Payments by a hash of their id: both halves have payments of most loans."""
    even = F.pmod(F.xxhash64("payment_id"), F.lit(2)) == 0
    return payments.where(even), payments.where(~even)


def _stream_once(spark, root, landed, store, parents, checkpoint):
    from ..sources import schemas as S
    from ..streaming import microbatch as MB
    MB.payment_stream(spark, f"{root}/{landed}", S.PAYMENTS, store, parents, f"{root}/{checkpoint}",
                      run_ts_of=lambda b: WH.FIXED_RUN_TS).awaitTermination()


def _stream_new_checkpoint(spark, d):
    """Two streams with a checkpoint each, whose batch numbers both start at 0."""
    from ..streaming import microbatch as MB
    root, src = _folder(spark, "stream"), _op(spark, d)
    store, parents = TableStore(spark, f"{root}/warehouse"), {k: v for k, v in src.items() if k != "payments"}
    for i, part in enumerate(_halves(src["payments"])):
        MB.land(part, f"{root}/landing{i}", "part=0")
        _stream_once(spark, root, f"landing{i}", store, parents, f"checkpoint{i}")
    return store


def _stream_duplicate_delivery(spark, d):
    """Every payment twice in one batch, and a third time in a later one."""
    from ..streaming import microbatch as MB
    root, src = _folder(spark, "stream"), _op(spark, d)
    store, parents = TableStore(spark, f"{root}/warehouse"), {k: v for k, v in src.items() if k != "payments"}
    MB.land(src["payments"].unionByName(src["payments"]), f"{root}/landing", "part=0")
    _stream_once(spark, root, "landing", store, parents, "checkpoint")
    MB.land(src["payments"], f"{root}/landing", "part=1")
    _stream_once(spark, root, "landing", store, parents, "checkpoint")
    return store


def _stream_late_parent(spark, d):
    """Half of the loans come after the first batch; the parents are read anew for each batch."""
    from ..streaming import microbatch as MB
    root, src = _folder(spark, "stream"), _op(spark, d)
    store = TableStore(spark, f"{root}/warehouse")
    early, late = src["loans"].where("loan_id % 2 = 0"), src["loans"].where("loan_id % 2 = 1")
    first, second = _halves(src["payments"])
    early.write.parquet(f"{root}/loans/part=0")

    def parents():
        loans = spark.read.schema(src["loans"].schema).parquet(f"{root}/loans")
        return {**{k: v for k, v in src.items() if k != "payments"}, "loans": loans.select(*src["loans"].columns)}
    MB.land(first, f"{root}/landing", "part=0")
    _stream_once(spark, root, "landing", store, parents, "checkpoint")
    late.write.parquet(f"{root}/loans/part=1")
    MB.land(second, f"{root}/landing", "part=1")
    _stream_once(spark, root, "landing", store, parents, "checkpoint")
    return store


def _load_after_failed_run(spark, d):
    """A run fails on a doubled loan after it has written tables; the corrected one succeeds."""
    src, store = _op(spark, d), TableStore(spark, f"{_folder(spark, 'retry')}/warehouse")
    try:
        WH.load(spark, store, {**src, "loans": src["loans"].unionByName(src["loans"])}, WH.FIXED_RUN_TS)
    except UP.DuplicateKeyError:
        WH.load(spark, store, src, WH.FIXED_RUN_TS)
    return store


def _backfill_then_increment(spark, d):
    """One half of the payments as a full load, the other as an increment."""
    src, store = _op(spark, d), TableStore(spark, f"{_folder(spark, 'mixed')}/warehouse")
    first, second = _halves(src["payments"])
    WH.load(spark, store, {**src, "payments": first}, WH.FIXED_RUN_TS)
    WH.load(spark, store, {**src, "payments": second}, WH.FIXED_RUN_TS, increment=True)
    return store


def _increment_then_backfill(spark, d):
    src, store = _op(spark, d), TableStore(spark, f"{_folder(spark, 'mixed')}/warehouse")
    first, _ = _halves(src["payments"])
    WH.load(spark, store, {**src, "payments": first}, WH.FIXED_RUN_TS, increment=True)
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    return store


def _restore_then_load(spark, d):
    """One half loaded, exported and restored elsewhere; the other half as an increment there."""
    from ..sources import snapshot as SN
    root, src = _folder(spark, "restore"), _op(spark, d)
    first, second = _halves(src["payments"])
    store, again = TableStore(spark, f"{root}/warehouse"), TableStore(spark, f"{root}/restored")
    WH.load(spark, store, {**src, "payments": first}, WH.FIXED_RUN_TS)
    SN.export(spark, store.read_all(), f"{root}/snapshots", "s", "resumable")
    SN.restore(spark, f"{root}/snapshots", "s", again)
    WH.load(spark, again, {**src, "payments": second}, WH.FIXED_RUN_TS, increment=True)
    return again


# surrogate keys follow the order of arrival; everything else equals one full load, and keys are unique
FP_BY_ID = ("payment_id, date_sk, method_sk, payment_amount, principal_portion, interest_portion, penalty_portion, loan_amount, "
            "interest_rate, customer_segment, loan_status, branch_code")
FL_BY_ID = ("loan_id, disbursement_date_sk, maturity_date_sk, principal_amount, interest_rate, tenure_months, outstanding_balance, "
            "total_paid, payment_count, is_active, is_defaulted, is_repaid, customer_segment, branch_code")


def _facts(store, table, key, cols):
    t = store.read(table)
    with shuffles_released(t.sparkSession):
        shared = not UP.repeated_keys(t, key).isEmpty()
    if not shared:                               # keys are counted first: rows of a key of their own need not move
        return t.where(F.col(key).isNotNull()).select(*cols.split(", "), F.lit(1).cast("long").alias("rows_of_key"))
    sharing = t.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    return t.join(sharing, key).select(*cols.split(", "), "rows_of_key")


for _name, _build in (("stream_new_checkpoint", _stream_new_checkpoint), ("stream_duplicate_delivery", _stream_duplicate_delivery),
                      ("stream_late_parent", _stream_late_parent), ("load_after_failed_run", _load_after_failed_run),
                      ("backfill_then_increment", _backfill_then_increment), ("increment_then_backfill", _increment_then_backfill),
                      ("restore_then_load", _restore_then_load)):
    for _t, _k, _cols in (("fact_payments", "payment_sk", FP_BY_ID), ("fact_loans", "loan_fact_sk", FL_BY_ID)):
        register(f"{_name}_{_t}", O.with_full(f"SELECT {_cols}, CAST(1 AS BIGINT) AS rows_of_key FROM {_t}"))(
            (lambda get, t, k, cols: lambda s, d: _facts(get(s, d), t, k, cols))(_once(_build), _t, _k, _cols))

# changes of customers, loans and payments as one stream: the tables end as after two loads of whole snapshots
def _changed_loans(src):
    """The loans of the second snapshot that the first one lacks.  A loan with a key of its own can differ by its status
    only, so no two snapshots are compared row by row; loans of keys that repeat are."""
    loans = src["loans"]
    if not UP.repeated_keys(loans, "loan_id").isEmpty():
        one, two = TD.first_snapshot(src)["loans"], TD.second_snapshot(src)["loans"]
        return two.exceptAll(one.select(*two.columns))
    two = TD.second_snapshot({**src, "loans": loans.withColumn("_was", F.col("status"))})["loans"]
    same = F.coalesce(TD.in_first_snapshot(), F.lit(False)) & F.col("status").eqNullSafe(F.col("_was"))
    return two.where(~same).select(*loans.columns)


def _parent_changes(spark, d):
    from ..streaming import microbatch as MB
    root, src = _folder(spark, "feed"), _op(spark, d)
    one = TD.first_snapshot(src)
    later = src["payments"].where(F.col("payment_date") >= F.lit(TD.SNAPSHOT_CUTOFF).cast("date"))
    store = TableStore(spark, f"{root}/warehouse")
    for i, part in enumerate(({t: one[t] for t in ("customers", "loans", "payments")}, {"loans": _changed_loans(src), "payments": later})):
        MB.land(MB.feed(spark, i, **part), f"{root}/landing", f"part={i}")
        MB.feed_stream(spark, f"{root}/landing", store, src["loan_products"], f"{root}/_checkpoint",
                       run_ts_of=lambda b: [WH.FIXED_RUN_TS, WH.SECOND_RUN_TS][min(b, 1)]).awaitTermination()
    return store


for _t, _cols in (("dim_customer", DIM_C), ("dim_loan", DIM_L), ("fact_payments", FP), ("fact_loans", FL)):
    register(f"stream_parent_changes_{_t}", O.with_incremental(f"SELECT {_cols} FROM r2_{_t}"))(
        (lambda t, cols: lambda s, d: _once(_parent_changes)(s, d).read(t).select(*cols.split(", ")))(_t, _cols))


# a store of whole-snapshot loads, laid out by bucket; the changed loans rewrite the buckets that they lie in
def _touched_buckets(spark, d):
    from . import delta as DL
    src, store = _op(spark, d), TableStore(spark, f"{_folder(spark, 'buckets')}/warehouse")
    WH.load(spark, store, TD.first_snapshot(src), WH.FIXED_RUN_TS)
    DL.adopt(spark, store)
    DL.load_changes(spark, store, {"loans": _changed_loans(src)}, WH.SECOND_RUN_TS)
    return store


register("upsert_touched_buckets", O.with_incremental(f"SELECT {DIM_L} FROM r2_dim_loan"))(
    lambda s, d: _once(_touched_buckets)(s, d).read("dim_loan").select(*DIM_L.split(", ")))

# reports kept up to date over a full load, an increment, a restore elsewhere, another increment and a backfill
def _maintained(spark, d):
    from . import maintained as M
    from ..sources import snapshot as SN
    root, src = _folder(spark, "maintained"), _op(spark, d)
    part = F.pmod(F.xxhash64("payment_id"), F.lit(4))
    quarter = [src["payments"].where(part == i) for i in range(4)]
    store, again = TableStore(spark, f"{root}/warehouse"), TableStore(spark, f"{root}/restored")
    WH.load(spark, store, {**src, "payments": quarter[0]}, WH.FIXED_RUN_TS)
    M.refresh(spark, store)
    WH.load(spark, store, {**src, "payments": quarter[1]}, WH.FIXED_RUN_TS, increment=True)
    SN.export(spark, store.read_all(), f"{root}/snapshots", "s", "resumable")
    SN.restore(spark, f"{root}/snapshots", "s", again)
    M.refresh(spark, again)
    WH.load(spark, again, {**src, "payments": quarter[2]}, WH.FIXED_RUN_TS, increment=True)
    WH.load(spark, again, src, WH.FIXED_RUN_TS)
    return again


def _report(name):
    def run(spark, d):
        from . import maintained as M
        return M.REPORTS[name](_once(_maintained)(spark, d))
    return run


for _name in ("monthly_revenue", "top_customers", "status_distribution", "payment_by_method", "branch_performance"):
    register(f"{_name}_maintained", REGISTRY[_name][1])(_report(_name))

# H15: a rerun of the same sources inserts nothing and leaves the facts with their first load stamp
def _rerun(spark, d):
    src, store = _op(spark, d), TableStore(spark, f"{_folder(spark, 'rerun')}/warehouse")
    WH.load(spark, store, src, WH.FIXED_RUN_TS)
    WH.load(spark, store, src, WH.SECOND_RUN_TS)
    return store


register("rerun_fact_payments", O.with_full(f"SELECT {FP}, {O.RUN1} AS etl_loaded_at FROM fact_payments"))(
    lambda s, d: _once(_rerun)(s, d).read("fact_payments").select(*FP.split(", "), "etl_loaded_at"))

# payments of one id that differ: some amounts changed, some rows repeated as they are
def _payment_conflicts(spark, d):
    pays = _op(spark, d)["payments"]
    again = pays.where("payment_id % 41 = 0").withColumn("amount", (F.col("amount") + 1).cast(pays.schema["amount"].dataType))
    found = UP.conflicts(pays.unionByName(again).unionByName(pays.where("payment_id % 43 = 0")), "payment_id")
    return found.select("payment_id", "rows", F.col("least.amount").alias("least_amount"), F.col("most.amount").alias("most_amount"))


register("payment_conflicts", O.with_source("""
SELECT payment_id, CASE WHEN payment_id % 43 = 0 THEN 3 ELSE 2 END::BIGINT AS rows, amount AS least_amount,
       CAST(amount + 1 AS DECIMAL(14,2)) AS most_amount
FROM src_payments WHERE payment_id % 41 = 0"""))(_payment_conflicts)

# the failed run keeps a row of its own, with the whole error text
register("load_after_failed_run_history", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'failed', TRUE), (CAST(2 AS BIGINT), 'success', FALSE)) "
         "AS t(run_id, status, has_error) WHERE (SELECT COUNT(*) FROM orders) > 0")(
    lambda s, d: RunLog(s, _once(_load_after_failed_run)(s, d).root).runs().select(
        "run_id", "status", F.col("error_message").isNotNull().alias("has_error")))


# ------------------------------------------- snapshots, run log, freshness
def _snapshot_roundtrip(spark, d):
    import uuid
    from ..session import scratch_path
    from ..sources import snapshot as SN
    from ..sources.store import TableStore
    root = scratch_path(spark, "snapshots", uuid.uuid4().hex)
    tables = {**{k: v for k, v in _op(spark, d).items()}, **_w(spark, d)}
    SN.export(spark, tables, root, "snap1", "all", "gzip")
    return SN.restore(spark, root, "snap1", TableStore(spark, f"{root}/restored"))


register("snapshot_roundtrip", O.with_full("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS rows_exported, COUNT(*) AS rows_restored, TRUE AS checksum_match "
    f"FROM {O._t(t)}" for t in ("customers", "loan_products", "loans", "payments", "dim_customer", "dim_loan",
                                "dim_date", "dim_product", "dim_payment_method", "fact_payments",
                                "fact_loans"))))(_snapshot_roundtrip)


# three exports of a chain: after the first run, after the second, and again; and what each one restores
def _snapshot_chain(spark, d):
    from ..sources.chain import SnapshotChain
    from ..sources.snapshot import TARGETS
    root, store = _folder(spark, "chain"), WH.built(spark, d, "incremental")
    chain, parts = SnapshotChain(spark, root), []
    for label, version in (("first", 1), ("second", 2), ("again", 2)):
        chain.export(store, label, TARGETS["warehouse"], version)
    for label in chain.snapshots():
        back = chain.restore(label, TableStore(spark, f"{root}/restored_{label}"))
        parts.append(chain.summary(label).join(back, "table_name").select(F.lit(label).alias("snapshot"), "table_name", "copied_rows", "rows_restored"))
    return reduce(DataFrame.unionByName, parts)


def _chain_sql() -> str:
    n = lambda t: f"(SELECT COUNT(*) FROM {t})"
    rows = []
    for t in ("dim_customer", "dim_loan", "fact_loans", "fact_payments"):
        new = n("r2_" + t) + (" - " + n("r1_" + t) if t == "fact_payments" else "")
        rows += [("first", t, n("r1_" + t), n("r1_" + t)), ("second", t, new, n("r2_" + t)), ("again", t, "0", n("r2_" + t))]
    for t, again in (("loan_products", True), ("dim_date", False), ("dim_payment_method", False)):
        name = "dim_product" if t == "loan_products" else t
        rows += [("first", name, n(t), n(t)), ("second", name, n(t) if again else "0", n(t)), ("again", name, "0", n(t))]
    return O.with_incremental("\nUNION ALL\n".join(
        f"SELECT '{a}' AS snapshot, '{t}' AS table_name, CAST({c} AS BIGINT) AS copied_rows, CAST({r} AS BIGINT) AS rows_restored" for a, t, c, r in rows))


register("snapshot_chain", _chain_sql())(_snapshot_chain)


def _snapshot_list(spark, d):
    import uuid
    from ..session import scratch_path
    from ..sources import snapshot as SN
    root = scratch_path(spark, "snapshots", uuid.uuid4().hex)
    tables = {**_op(spark, d), **_w(spark, d)}
    SN.export(spark, tables, root, "operational", "operational", "gzip")
    SN.export(spark, tables, root, "warehouse", "warehouse", "gzip")
    SN.max_compression_export(spark, tables, root, "all_zstd")
    return SN.list_snapshots(spark, root).select("snapshot", "tables", "total_rows", (F.col("total_bytes") > 0).alias("has_bytes"))


register("snapshot_list", O.with_full("""
SELECT 'operational' AS snapshot, CAST(4 AS BIGINT) AS tables,
       (SELECT COUNT(*) FROM src_customers) + (SELECT COUNT(*) FROM loan_products) + (SELECT COUNT(*) FROM src_loans)
       + (SELECT COUNT(*) FROM src_payments) AS total_rows, TRUE AS has_bytes
UNION ALL
SELECT 'warehouse', CAST(7 AS BIGINT), (SELECT COUNT(*) FROM dim_customer) + (SELECT COUNT(*) FROM dim_loan)
       + (SELECT COUNT(*) FROM dim_date) + (SELECT COUNT(*) FROM dim_product) + (SELECT COUNT(*) FROM dim_payment_method)
       + (SELECT COUNT(*) FROM fact_payments) + (SELECT COUNT(*) FROM fact_loans), TRUE
UNION ALL
SELECT 'all_zstd', CAST(11 AS BIGINT), (SELECT COUNT(*) FROM src_customers) + (SELECT COUNT(*) FROM loan_products)
       + (SELECT COUNT(*) FROM src_loans) + (SELECT COUNT(*) FROM src_payments) + (SELECT COUNT(*) FROM dim_customer)
       + (SELECT COUNT(*) FROM dim_loan) + (SELECT COUNT(*) FROM dim_date) + (SELECT COUNT(*) FROM dim_product)
       + (SELECT COUNT(*) FROM dim_payment_method) + (SELECT COUNT(*) FROM fact_payments)
       + (SELECT COUNT(*) FROM fact_loans), TRUE"""))(_snapshot_list)


def _run_history(spark, d):
    from ..operators.runlog import RunLog, run_history
    store = WH.built(spark, d, "incremental")
    return run_history(RunLog(spark, store.root).runs(), 10).select(
        "run_id", "rows_inserted", "rows_updated", "status", "error")


register("run_history", O.with_incremental("""
SELECT CAST(1 AS BIGINT) AS run_id,
       (SELECT COUNT(*) FROM r1_fp_cand) + (SELECT COUNT(*) FROM r1_fl_rows) AS rows_inserted,
       (SELECT COUNT(*) FROM r1_stg_customers) + (SELECT COUNT(*) FROM r1_stg_loans) AS rows_updated,
       'success' AS status, CAST(NULL AS VARCHAR) AS error
UNION ALL
SELECT CAST(2 AS BIGINT), (SELECT COUNT(*) FROM r2_fp_new) + (SELECT COUNT(*) FROM r2_fl_rows),
       (SELECT COUNT(*) FROM r2_stg_customers) + (SELECT COUNT(*) FROM r2_stg_loans), 'success', NULL
ORDER BY run_id DESC LIMIT 10"""))(_run_history)

# I16: runs are stamped with the clock, not with the run's parameter
register("run_clock", O.with_source("""
SELECT CAST(run AS BIGINT) AS run_id, TRUE AS in_order, TRUE AS before_now FROM range(1, 3) t(run) WHERE (SELECT COUNT(*) FROM src_payments) > 0"""))(
    lambda s, d: RunLog(s, WH.built(s, d, "incremental").root).runs().select(
        "run_id", (F.col("run_started_at") <= F.col("run_finished_at")).alias("in_order"),
        (F.col("run_finished_at") <= F.current_timestamp().cast("timestamp_ntz")).alias("before_now")))

register("freshness", O.with_full("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CASE WHEN COUNT(*) > 0 THEN {O.RUN1} END AS last_loaded_at, "
    f"CASE WHEN COUNT(*) > 0 THEN CAST(86400 AS DOUBLE) END AS lag_seconds FROM {t}"
    for t in ("fact_payments", "fact_loans", "stg_customers", "stg_loans", "stg_payments"))))(
    lambda s, d: V.freshness(_w(s, d), F.lit(WH.SECOND_RUN_TS).cast("timestamp_ntz")))


# ------------------------------------------------ previews (F4: sample rows)
for _t, _k, _cols in (("customers", "customer_id", "customer_id, full_name, segment, city"),
                      ("loans", "loan_id", "loan_id, customer_id, amount, interest_rate, status, outstanding_balance"),
                      ("payments", "payment_id", "payment_id, loan_id, amount, payment_method, payment_date")):
    register(f"preview_{_t}", O.with_source(f"SELECT {_cols} FROM src_{_t} ORDER BY {_k} LIMIT 5"))(
        (lambda t, k, cols: lambda s, d: _op(s, d)[t].select(*cols.split(", ")).orderBy(k).limit(5))(
            _t, _k, _cols))


# --------------------------------- operational write path: post -> log
def _write_path(spark, d):
    op = _op(spark, d)
    _, nxt, log = PO.post_and_log(op["loans"], op["payments"], F.lit(WH.SECOND_RUN_TS).cast("timestamp_ntz"),
                                  compare=LOAN_DIFF_COLS)
    touched = nxt.where(F.col("updated_at").isNotNull()).select(F.col("loan_id").alias("record_id"),
                                                                F.lit(True).alias("updated_at_touched"))
    return (log.join(touched, "record_id", "left")
            .select("operation", "record_id", "changed_columns",
                    F.get_json_object("new_values", "$.status").alias("new_status"),
                    F.coalesce(F.col("updated_at_touched"), F.lit(False)).alias("updated_at_touched")))


register("operational_write_path", O.with_source("," + POST_SQL + """,
d AS (SELECT loan_id, SUM(applied) AS delta FROM z WHERE applied > 0 GROUP BY loan_id),
n AS (SELECT l.loan_id, l.status AS old_status,
             CASE WHEN l.outstanding_balance - d.delta <= 0 THEN 'repaid' ELSE l.status END AS new_status
      FROM src_loans l JOIN d ON l.loan_id = d.loan_id)
SELECT 'UPDATE' AS operation, loan_id AS record_id,
       concat_ws(',', CASE WHEN new_status <> old_status THEN 'status' END, 'outstanding_balance')
         AS changed_columns,
       new_status, TRUE AS updated_at_touched
FROM n"""))(_write_path)


def queries() -> dict[str, Q]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

