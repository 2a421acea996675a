"""Reports kept up to date: stored sums and counts, folded forward by the payments of each commit.

``fact_payments`` is insert-only and its keys are dense, so the rows after the
last folded key are exactly the new ones, whatever directories they lie in
(compacted, restored).  Sums and counts add up; the number of distinct loans of
a customer or branch does not, so ``loan_support`` holds the payments of each (group, loan),
by bucket of the loan: a pair that it lacks is a new loan of the group.

``refresh`` folds what is new and commits; ``report`` reads the stored sums and adds
whatever is not folded yet, so it never lags behind the fact table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import SUM_MONEY, mean_of, pct
from ..sources.store import TableStore
from .delta import _Run

MONTH = "CAST(date_sk DIV 100 AS INT)"
#: table -> its groups, and its measures over the rows of fact_payments (``loans`` comes from the support).
SUMS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "sum_month": ({"month_sk": MONTH}, {"revenue": "sum(payment_amount)", "principal": "sum(principal_portion)",
                                        "interest": "sum(interest_portion)", "payments": "count(payment_sk)"}),
    "sum_status": ({"loan_status": "loan_status", "customer_segment": "customer_segment"},
                   {"payments": "count(payment_sk)", "amount": "sum(loan_amount)", "rates": "sum(interest_rate)", "rated": "count(interest_rate)"}),
    "sum_method": ({"method_sk": "method_sk"}, {"amount": "sum(payment_amount)", "payments": "count(payment_sk)"}),
    "sum_branch": ({"branch_code": "branch_code"},
                   {"collected": "sum(payment_amount)", "interest": "sum(interest_portion)", "rates": "sum(interest_rate)",
                    "rated": "count(interest_rate)", "loans": "NULL"}),
    "sum_customer": ({"customer_sk": "customer_sk"},
                     {"paid": "sum(payment_amount)", "payments": "count(payment_sk)", "last_sk": "max(date_sk)", "loans": "NULL"}),
}
MONEY = ("revenue", "principal", "interest", "amount", "rates", "collected", "paid")
SUPPORT = "loan_support"
#: Groups whose distinct loans are counted: the table, and its key as text.
COUNTED = {"sum_customer": "CAST(customer_sk AS STRING)", "sum_branch": "branch_code"}
#: Tables that grow with the data; the others have a row per month, status, method or branch.
BUCKETED = {"sum_customer": "customer_sk", SUPPORT: "loan_sk"}


def _typed(name: str, c: Column) -> Column:
    return c.cast(SUM_MONEY if name in MONEY else "int" if name == "last_sk" else "long").alias(name)


def _merged(table: str, *parts: DataFrame | None) -> DataFrame:
    """Rows of the same groups as one: sums and counts add up, the last day is the greatest."""
    groups, measures = (list(x) for x in SUMS[table])
    rows = reduce(DataFrame.unionByName, [p.select(*groups, *measures) for p in parts if p is not None])
    return rows.groupBy(*groups).agg(*[_typed(m, F.max(m) if m == "last_sk" else F.sum(m)) for m in measures])


class _Fold:
    """What the payments after the last folded key add to each table."""

    def __init__(self, store: TableStore):
        self.run = _Run(store)
        facts = self.run.prev.get("fact_payments")
        if facts is None:
            raise ValueError("the store holds no payment facts")
        self.top = int(facts.get("max_key") or 0)
        kept = self.run.prev.get(SUPPORT)
        self.last = int(kept.get("max_key") or 0) if kept else 0
        if self.last > self.top:                                     # the facts were replaced: start anew
            self.run.prev = {t: e for t, e in self.run.prev.items() if t not in (*SUMS, SUPPORT)}
            self.last = 0
        self.new = store.read_entry(facts).where(F.col("payment_sk") > self.last)
        self.pairs = self.new.select("loan_sk", F.explode(F.array(*[
            F.struct(F.lit(t).alias("of"), F.expr(k).alias("group")) for t, k in COUNTED.items()])).alias("x")) \
            .groupBy("x.of", "x.group", "loan_sk").agg(F.count(F.lit(1)).alias("payments"))

    def stored(self, table: str, only: list[int] | None = None) -> DataFrame | None:
        e = self.run.entry(table)
        if e is None:
            return None
        return self.run.store.read_buckets(e, only) if e.get("layout") else self.run.store.read_entry(e)

    def added(self, table: str, pairs: DataFrame, support: DataFrame | None) -> DataFrame:
        """The table's rows for the new payments alone."""
        groups, measures = SUMS[table]
        out = self.new.groupBy(*[F.expr(c).alias(g) for g, c in groups.items()]).agg(*[_typed(m, F.expr(c)) for m, c in measures.items()])
        if table in COUNTED:
            own = pairs.where(F.col("of") == table).alias("p")
            if support is not None:
                s = support.alias("s")
                own = own.join(s, F.col("p.group").eqNullSafe(F.col("s.group")) & (F.col("p.loan_sk") == F.col("s.loan_sk"))
                               & (F.col("s.of") == table), "left_anti")
            g = next(iter(groups))
            loans = own.groupBy(F.col("p.group").cast(out.schema[g].dataType).alias(g)).agg(F.count(F.lit(1)).alias("loans"))
            out = out.drop("loans").join(loans.withColumnRenamed(g, "_g"), F.col(g).eqNullSafe(F.col("_g")), "left").drop("_g") \
                .withColumn("loans", F.coalesce("loans", F.lit(0)).cast("long"))
        return out


def refresh(spark: SparkSession, store: TableStore) -> int:
    """Fold the payments since the last refresh into the stored sums and commit them; returns the version."""
    fold = _Fold(store)
    run = fold.run
    if fold.last == fold.top and SUPPORT in run.prev:
        return store.current_version()
    pairs = run.scratch("new_pairs", fold.pairs)
    touched = run.touched(SUPPORT, pairs)
    support = fold.stored(SUPPORT, touched)
    for table in SUMS:
        rows = run.scratch(f"new_{table}", fold.added(table, pairs, support))
        if table in BUCKETED:
            of = run.touched(table, rows)
            run.put(table, _merged(table, fold.stored(table, of), rows), of, run.rewritten[f"_new_{table}"])
        else:
            run.entries[table] = store.write_table(table, _merged(table, fold.stored(table), rows).coalesce(1), run.version)
    both = pairs if support is None else pairs.unionByName(support)
    run.put(SUPPORT, both.groupBy("of", "group", "loan_sk").agg(F.sum("payments").alias("payments")), touched, run.rewritten["_new_pairs"])
    run.entries[SUPPORT]["max_key"] = fold.top                       # how far the sums go
    return store.commit(list(run.entries.values()), run.version, keep=run.prev)


def current(store: TableStore, table: str) -> DataFrame:
    """The stored sums with the payments that are not folded yet."""
    fold = _Fold(store)
    if fold.last == fold.top and fold.stored(table) is not None:
        return fold.stored(table)
    support = fold.stored(SUPPORT) if table in COUNTED else None
    return _merged(table, fold.stored(table), fold.added(table, fold.pairs, support))


# ----------------------------------------------------------------- the reports
def monthly_revenue(store: TableStore) -> DataFrame:
    months = store.read("dim_date").select(F.expr(MONTH).alias("month_sk"), "year", "month", "month_name").distinct()
    return current(store, "sum_month").join(months, "month_sk").select(
        "year", "month", "month_name", F.col("revenue").alias("total_revenue"), F.col("principal").alias("total_principal"),
        F.col("interest").alias("total_interest"), F.col("payments").alias("payment_count")).orderBy("year", "month")


def top_customers(store: TableStore) -> DataFrame:
    # type-2 history has a key per version of a customer: grouped again by the attributes, like the view
    who = store.read("dim_customer").select("customer_sk", "customer_id", "full_name", "segment", "city")
    sums = current(store, "sum_customer").join(who, "customer_sk").groupBy("customer_id", "full_name", "segment", "city").agg(
        F.sum("loans").alias("total_loans"), F.sum("paid").cast(SUM_MONEY).alias("total_paid"), F.sum("payments").alias("payment_count"),
        F.max("last_sk").alias("_last"))
    days = store.read("dim_date").select(F.col("date_sk").alias("_last"), F.col("full_date").alias("last_payment_date"))
    return sums.join(days, "_last").drop("_last").orderBy(F.col("total_paid").desc_nulls_first())


def loan_status_distribution(store: TableStore) -> DataFrame:
    return current(store, "sum_status").select(
        "loan_status", "customer_segment", F.col("payments").alias("loan_count"), F.col("amount").alias("total_loan_amount"),
        mean_of(F.col("rates"), F.col("rated")).alias("avg_interest_rate")).orderBy(F.col("loan_count").desc_nulls_first())


def payment_by_method(store: TableStore) -> DataFrame:
    names = store.read("dim_payment_method").select("method_sk", "method_name")
    total = F.sum("amount").over(Window.partitionBy())               # one row per method
    return current(store, "sum_method").join(names, "method_sk").select(
        "method_name", F.col("payments").alias("payment_count"), F.col("amount").alias("total_amount"),
        pct(F.col("amount"), total).cast("decimal(7,2)").alias("pct_of_total")).orderBy(F.col("total_amount").desc_nulls_first())


def branch_performance(store: TableStore) -> DataFrame:
    return current(store, "sum_branch").select(
        "branch_code", F.col("loans").alias("loan_count"), F.col("collected").alias("total_collected"),
        F.col("interest").alias("total_interest_earned"), mean_of(F.col("rates"), F.col("rated")).alias("avg_rate")).orderBy(
        F.col("total_collected").desc_nulls_first())


REPORTS = {"monthly_revenue": monthly_revenue, "top_customers": top_customers, "status_distribution": loan_status_distribution,
           "payment_by_method": payment_by_method, "branch_performance": branch_performance}
