"""Posting a batch of payments against loan balances.

Per loan, payments apply in (payment_date, payment_id) order: each one
is capped at the balance left by the earlier ones, split 75 % / 25 %
into principal / interest (each rounded to cents), and a loan whose
balance reaches zero becomes ``repaid``.  Closed form over a running sum
(no row-by-row loop):

    before  = greatest(balance - sum(earlier amounts), 0)
    applied = least(amount, before)

Payments of unknown loans and payments that would apply nothing are
rejected.  Balance updates from many payments of one loan are summed in
one aggregation and joined once (no lost update).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S
from .scan import running_sum

PRINCIPAL_SHARE = Decimal("0.75")
INTEREST_SHARE = Decimal("0.25")


def post_payments(loans: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posted payments, new loan balances/status, rejects)."""
    bal = loans.select("loan_id", F.col("outstanding_balance").alias("balance_before_batch"), "status")
    known = batch.join(bal, "loan_id", "inner")
    unknown = batch.join(bal.select("loan_id"), "loan_id", "left_anti") \
        .select("payment_id", "loan_id", "amount", F.lit("unknown_loan").alias("reason"))
    # running sum on exact cents (long) over the skew-safe scan
    cents = known.withColumn("_c", (F.col("amount") * 100).cast("long"))
    scanned = running_sum(cents, "loan_id", ["payment_date", "payment_id"], "_c", "_prev_c")
    prev = (F.col("_prev_c").cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    before = F.greatest(F.col("balance_before_batch") - prev, F.lit(0).cast(S.MONEY))
    posted = (scanned.withColumn("balance_before", before.cast(S.MONEY))
              .withColumn("applied", F.least(F.col("amount"), F.col("balance_before")).cast(S.MONEY)))
    rejects = unknown.unionByName(
        posted.where(F.col("applied") <= 0)
        .select("payment_id", "loan_id", "amount", F.lit("nothing_to_apply").alias("reason")))
    ok = (posted.where(F.col("applied") > 0)
          .select("payment_id", "loan_id", "payment_date", "amount", "applied", "balance_before",
                  F.round(F.col("applied") * F.lit(PRINCIPAL_SHARE), 2).cast(S.MONEY).alias("principal_portion"),
                  F.round(F.col("applied") * F.lit(INTEREST_SHARE), 2).cast(S.MONEY).alias("interest_portion"),
                  (F.col("balance_before") - F.col("applied")).cast(S.MONEY).alias("balance_after")))
    new_loans = apply_balance_deltas(loans, ok.select("loan_id", F.col("applied").alias("delta")))
    return ok, new_loans, rejects


def apply_balance_deltas(loans: DataFrame, deltas: DataFrame) -> DataFrame:
    """Subtract the sum of deltas per loan (partial aggregation first),
    mark loans at or below zero as repaid."""
    per_loan = deltas.groupBy("loan_id").agg(F.sum("delta").alias("_d"), F.count(F.lit(1)).alias("_n"))
    j = loans.join(per_loan, "loan_id", "left")
    new_bal = (F.col("outstanding_balance") - F.coalesce(F.col("_d"), F.lit(0))).cast(S.MONEY)
    return (j.withColumn("payments_posted", F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
            .withColumn("_nb", new_bal)
            .withColumn("status", F.when(F.col("_n").isNotNull() & (F.col("_nb") <= 0), F.lit("repaid"))
                        .otherwise(F.col("status")))
            .withColumn("outstanding_balance", F.col("_nb"))
            .drop("_d", "_n", "_nb"))


def post_and_log(loans: DataFrame, batch: DataFrame, at, key: str = "loan_id",
                 compare: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The operational write path: post the batch, produce the next loans
    version with ``updated_at`` touched on changed rows, and the change log
    between the two versions.  Returns (posted, next loans, change log)."""
    from .changes import diff, touch_updated
    posted, nxt, _ = post_payments(loans, batch)
    nxt = touch_updated(loans, nxt.drop("payments_posted"), key, at)
    cols = compare or [c for c in loans.columns if c not in (key, "updated_at")]
    log = diff(loans.select(key, *cols), nxt.select(key, *cols), key, cols)
    return posted, nxt, log
