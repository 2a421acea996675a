"""The load of changes: a batch of changed source rows instead of whole snapshots.

Every keyed table lies in hash buckets of its key.  A batch reads and rewrites
the buckets that it touches and carries the others over in the manifest, so its
cost follows the change.  Beside the warehouse's own tables the store keeps

    stg_customers, stg_loans   the source rows as of the last change
    loans_by_holder            (customer_id, loan_id), by customer
    payment_totals             gross amount and count per loan
    waiting_payments           payments that no fact row could be built for, by loan

The loans to look at are the changed ones, all loans of changed customers (from
``loans_by_holder``) and those of new payments.  Waiting payments are read only
for loans whose loan or customer came with the batch, or that still miss one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runlog import RunLog
from ..operators.upsert import ConflictingRowsError, absent, one_per_key
from ..session import small_splits
from ..sources import schemas as S
from ..sources.readers import extract_payments
from ..sources.store import TableStore, touched_buckets
from . import etl
from .warehouse import FIXED_RUN_TS, PARTITIONED, _now, fold_reports

#: The bucket key of each table.
KEYS = {"stg_customers": "customer_id", "stg_loans": "loan_id", "dim_customer": "customer_id", "dim_loan": "loan_id",
        "fact_loans": "loan_id", "payment_totals": "loan_id", "waiting_payments": "loan_id", "loans_by_holder": "customer_id"}
#: Those of stored reports (``plans.maintained``), where a store keeps any.
REPORT_KEYS = {"loan_support": "loan_sk", "sum_customer": "customer_sk"}
#: Rows of a bucket when a table is laid out, and the least and most buckets of a table.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 8, 65_536
#: Marks a changed row whose source row is gone.
DELETED = "_deleted"

__all__ = ["load_changes", "adopt", "rebucket", "FIXED_RUN_TS"]


def key_of(table: str) -> str:
    return KEYS.get(table) or REPORT_KEYS[table]


def bucket_count(rows: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))


class _Run:
    """Tables of one version in the making."""

    def __init__(self, store: TableStore):
        self.store, self.prev, self.version = store, store.manifest(), store.current_version() + 1
        self.entries: dict[str, dict] = {}
        self.rewritten: dict[str, int] = {}

    def entry(self, table: str) -> dict | None:
        return self.entries.get(table) or self.prev.get(table)

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of ``table`` that hold ``keys`` (none if it does not exist yet)."""
        e = self.entry(table)
        return touched_buckets(keys, key_of(table), json.loads(e["layout"])["count"]) if e else []

    def read(self, table: str, only: list[int]) -> DataFrame | None:
        e = self.entry(table)
        return self.store.read_buckets(e, only) if e else None

    def scratch(self, name: str, df: DataFrame) -> DataFrame:
        """A step's result, written once; not part of the version."""
        conflict = "_conflict" in df.columns
        e = self.store.write_table(f"_{name}", df, self.version, metrics={"conflicts": F.sum("_conflict")} if conflict else None, drop=["_conflict"])
        if e["metrics"].get("conflicts"):
            raise ConflictingRowsError(f"{name}: {e['metrics']['conflicts']} keys have rows that differ")
        self.rewritten[f"_{name}"] = e["new_rows"]
        return self.store.read_paths(e["new_path"], e["schema_json"])

    def put(self, table: str, df: DataFrame, touched: list[int], rows: int = 0) -> None:
        """The rows that the touched buckets of ``table`` have from now on; all rows, if it is new."""
        e = self.entry(table)
        metrics = {op: F.sum(F.when(F.col("_op") == op, 1).otherwise(0)) for op in ("insert", "update")} if "_op" in df.columns else {}
        count = json.loads(e["layout"])["count"] if e else bucket_count(rows)
        sk = etl.SK_COLS.get(table)
        self.entries[table] = self.store.write_buckets(table, df, self.version, key_of(table), count, e, touched if e else None, metrics,
                                                       ["_op", "_dup"], sk if sk in df.columns else None)
        self.rewritten[table] = len(touched) if e else count

    def key_start(self, table: str) -> int:
        e = self.entry(table)
        return int(e.get("max_key") or 0) if e else 0


def _without(rows: DataFrame | None, keys: DataFrame, on: str | list[str], new: DataFrame) -> DataFrame:
    """``rows`` less those whose key is among ``keys``, and ``new``."""
    return new if rows is None else rows.join(keys.select(*([on] if isinstance(on, str) else on)), on, "left_anti").unionByName(new.select(*rows.columns))


def _changed(run: _Run, name: str, df: DataFrame, key: str, cols: list[str], gone) -> DataFrame:
    """The batch's rows, one a key (rows of a key that differ refuse it), with ``_gone`` where the source no longer has the row."""
    flag = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else F.lit(False)
    return run.scratch(f"{name}_changes", one_per_key(df.select(*cols, (flag | gone).alias("_gone")), key))


def load_changes(spark: SparkSession, store: TableStore, changes: dict[str, DataFrame], run_ts: str | None = None,
                 batch_id: int | None = None, log: RunLog | None = None) -> dict:
    """One run over changed rows of ``customers``, ``loans`` and ``payments`` (each may be missing); returns its metrics.

    A changed row is the whole row as it is now; a true ``_deleted`` says that it is gone.  ``loan_products``
    are needed by the first run.  Several states of a row in one batch are the caller's to reduce
    (``streaming.microbatch.feed_stream`` does by sequence number); rows of one key that differ refuse the
    batch.  The tables end as after whole-snapshot loads of the same source states (``etl_loaded_at`` of a loan fact
    is that of the last run that touched it).  A payment that is loaded or waits already is not taken again;
    its loan does not change.  Nothing is committed if any step fails.
    """
    log = log or RunLog(spark, store.root)
    started = _now()
    run_ts = run_ts or started.strftime("%Y-%m-%d %H:%M:%S")
    run_id = log.next_run_id()
    log.open(run_id, started, batch_id)
    try:
        run = _Run(store)
        for t, e in run.prev.items():
            if t in {**KEYS, **REPORT_KEYS} and not e.get("layout"):
                raise ValueError(f"{t} comes from whole-snapshot loads: adopt() the store first")
        with small_splits(spark):
            metrics = _load(spark, run, changes, run_ts)
        store.commit(list(run.entries.values()), run.version, keep=run.prev)
    except Exception as exc:
        log.close(run_id, started, _now(), "failed", error=str(exc), batch_id=batch_id)
        raise
    log.close(run_id, started, _now(), "success", metrics, batch_id=batch_id)
    fold_reports(spark, store)
    return metrics


def _load(spark: SparkSession, run: _Run, changes: dict[str, DataFrame], run_ts: str) -> dict:
    store, t = run.store, etl.ts_lit(run_ts)
    static: dict[str, Callable[[], DataFrame]] = {
        "dim_date": lambda: etl.calendar(spark), "dim_payment_method": lambda: etl.dim_payment_method(spark),
        "dim_product": lambda: etl.load_dim_product(None, changes["loan_products"]).drop("_op", "_dup")}
    for name, build in static.items():
        if name not in run.prev:
            run.entries[name] = store.write_table(name, build(), run.version, key_col=etl.SK_COLS.get(name))
    dd, methods = (store.read_entry(run.entry(n)) for n in ("dim_date", "dim_payment_method"))

    # customers
    no = F.lit(False)
    parents_changed: list[DataFrame] = []
    customers = None
    if "customers" in changes:
        inactive = ~F.coalesce(F.col("is_active"), no)
        customers = _changed(run, "customers", changes["customers"], "customer_id", S.STG_CUSTOMER_COLS, inactive)
        n = run.rewritten["_customers_changes"]
        touched = run.touched("stg_customers", customers)
        here = customers.where("NOT _gone").drop("_gone")
        run.put("stg_customers", _without(run.read("stg_customers", touched), customers, "customer_id", here.withColumn("etl_loaded_at", t)), touched, n)
        touched = run.touched("dim_customer", here)
        if touched or not run.entry("dim_customer"):
            run.put("dim_customer", etl.load_dim_customer(run.read("dim_customer", touched), here, run_ts, run.key_start("dim_customer")), touched, n)

    # loans, and which customer holds them
    if "loans" in changes:
        loans = _changed(run, "loans", changes["loans"], "loan_id", S.STG_LOAN_COLS, no)
        n = run.rewritten["_loans_changes"]
        touched = run.touched("stg_loans", loans)
        before = run.read("stg_loans", touched)
        here = loans.where("NOT _gone").drop("_gone")
        pairs = here.where("customer_id IS NOT NULL").select("customer_id", "loan_id")
        if before is None:
            run.put("loans_by_holder", pairs, [], n)
        else:
            held = before.join(loans.select("loan_id"), "loan_id", "left_semi").where("customer_id IS NOT NULL").select("customer_id", "loan_id")
            moved = run.scratch("holder_moves", held.withColumn("_old", F.lit(1)).unionByName(pairs.withColumn("_old", F.lit(0)))
                                .groupBy("customer_id", "loan_id").agg(F.min("_old").alias("_old"), F.count(F.lit(1)).alias("_n")).where("_n = 1"))
            buckets = run.touched("loans_by_holder", moved)
            if buckets:
                run.put("loans_by_holder", _without(run.read("loans_by_holder", buckets), moved.where("_old = 1"), ["customer_id", "loan_id"],
                                                    moved.where("_old = 0").select("customer_id", "loan_id")), buckets)
        run.put("stg_loans", _without(before, loans, "loan_id", here.withColumn("etl_loaded_at", t)), touched, n)
        touched = run.touched("dim_loan", here)
        if touched or not run.entry("dim_loan"):
            run.put("dim_loan", etl.load_dim_loan(run.read("dim_loan", touched), here, run_ts, run.key_start("dim_loan")), touched, n)
        parents_changed.append(loans.select("loan_id"))
    if customers is not None and run.entry("loans_by_holder"):
        held = run.read("loans_by_holder", run.touched("loans_by_holder", customers))
        parents_changed.append(held.join(customers.select("customer_id"), "customer_id", "left_semi").select("loan_id"))

    # the loans to look at, and those of them that pass every join
    batch = None
    if "payments" in changes:
        batch = run.scratch("payments_changes", one_per_key(extract_payments(changes["payments"]), "payment_id"))
    of_parents = parents_changed[0] if parents_changed else None
    for p in parents_changed[1:]:
        of_parents = of_parents.unionByName(p)
    keys = [k for k in (of_parents, batch.select("loan_id") if batch is not None else None) if k is not None]
    metrics = {"version": run.version, "payments_inserted": 0, "loans_inserted": 0, "loans_updated": 0, "rows_inserted": 0,
               "rows_updated": run.rewritten.get("_customers_changes", 0) + run.rewritten.get("_loans_changes", 0)}
    if keys and run.entry("stg_loans") and run.entry("stg_customers"):
        look = keys[0].unionByName(keys[1]) if len(keys) > 1 else keys[0]
        look = run.scratch("loans_to_look_at", look.where("loan_id IS NOT NULL").distinct())
        of_loans = {n: run.touched(n, look) for n in ("stg_loans", "dim_loan")}
        found = run.read("stg_loans", of_loans["stg_loans"]).join(look, "loan_id", "left_semi")
        holders = run.scratch("holders", found.where("customer_id IS NOT NULL").select("customer_id").distinct())
        stg = {"stg_loans": found, "stg_customers": run.read("stg_customers", run.touched("stg_customers", holders)).join(holders, "customer_id", "left_semi")}
        dim_c, dim_l = run.read("dim_customer", run.touched("dim_customer", holders)), run.read("dim_loan", of_loans["dim_loan"])
        ctx = run.scratch("loan_context", etl.loan_context(stg, dim_c, dim_l))
        _payments(spark, run, batch, ctx, of_parents, dd, methods, run_ts, metrics)
        touched = run.touched("fact_loans", ctx)
        if touched or not run.entry("fact_loans"):
            totals = run.read("payment_totals", run.touched("payment_totals", ctx)) if run.entry("payment_totals") else \
                spark.createDataFrame([], "loan_id long, _paid decimal(38,2), _n long")
            rows = run.scratch("loan_rows", etl.fact_loan_rows(spark, {}, ctx, run_ts, dd, totals))
            run.put("fact_loans", etl.load_fact_loans(run.read("fact_loans", touched), rows, run_ts, run.key_start("fact_loans")), touched,
                    run.rewritten["_loan_rows"])
            ops = run.entries["fact_loans"]["metrics"]
            metrics |= {"loans_inserted": int(ops["insert"] or 0), "loans_updated": int(ops["update"] or 0)}
    elif batch is not None:                                    # no loan or no customer yet: all payments wait
        _payments(spark, run, batch, None, None, dd, methods, run_ts, metrics)
    metrics["rows_inserted"] = metrics["payments_inserted"] + metrics["loans_inserted"] + metrics["loans_updated"]
    metrics["staged"] = {k[1:-8]: v for k, v in run.rewritten.items() if k.endswith("_changes")}
    metrics["buckets"] = {k: v for k, v in run.rewritten.items() if not k.startswith("_")}
    return metrics


def _payments(spark: SparkSession, run: _Run, batch: DataFrame | None, ctx: DataFrame | None, of_parents: DataFrame | None,
              dd: DataFrame, methods: DataFrame, run_ts: str, metrics: dict) -> None:
    """New facts from the batch and from payments that no longer wait; the others wait, by loan."""
    store, facts = run.store, run.entry("fact_payments")
    date_ok = dd.select(F.col("full_date").alias("payment_date"))
    waits_for: list[DataFrame] = []
    if batch is not None:
        if facts:
            batch = run.scratch("payments_unknown", absent(store.read_entry(facts), batch, "payment_id"))
        misses = batch if ctx is None else batch.join(ctx.select("loan_id"), "loan_id", "left_anti").unionByName(
            batch.join(date_ok, "payment_date", "left_anti").select(*batch.columns))
        waits_for.append(misses.select("loan_id"))
    if of_parents is not None and run.entry("waiting_payments"):
        waits_for.append(ctx.select("loan_id").join(of_parents.distinct(), "loan_id", "left_semi"))
    loans = waits_for[0] if waits_for else None
    for w in waits_for[1:]:
        loans = loans.unionByName(w)
    buckets = run.touched("waiting_payments", loans) if loans is not None else []
    waiting = run.read("waiting_payments", buckets) if buckets else None
    fresh = batch
    if batch is not None and waiting is not None:
        fresh = run.scratch("payments_fresh", batch.join(waiting.select("payment_id"), "payment_id", "left_anti"))
    if fresh is not None:
        delta = run.scratch("totals_delta", etl.payment_totals(fresh).where("loan_id IS NOT NULL"))
        touched = run.touched("payment_totals", delta)
        if touched or not run.entry("payment_totals"):
            run.put("payment_totals", etl.merge_totals(run.read("payment_totals", touched), delta), touched, run.rewritten["_totals_delta"])
    staged = [x.select(*S.STG_PAYMENT_COLS) for x in (fresh, waiting) if x is not None]
    if not staged:
        return
    staged = staged[0].unionByName(staged[1]) if len(staged) > 1 else staged[0]
    loaded = None
    if ctx is not None:
        rows = etl.fact_payment_candidates(spark, {"stg_payments": staged}, ctx, run_ts, dd, methods)
        rows = etl.with_payment_keys(rows, run.key_start("fact_payments"), run_ts)
        year, expr = PARTITIONED["fact_payments"]
        e = store.write_table("fact_payments", rows.withColumn(year, F.expr(expr)), run.version, append_to=facts, key_col="payment_sk",
                              partition_by=[year])
        run.entries["fact_payments"] = e
        metrics["payments_inserted"] = e["new_rows"]
        loaded = store.read_paths(e["new_path"], e["schema_json"]).select("payment_id")
    left = staged if loaded is None else staged.join(loaded, "payment_id", "left_anti")
    # nothing came and nothing was released: the buckets stay as they are
    moved = metrics["payments_inserted"] or (fresh is not None and not fresh.isEmpty())
    if not run.entry("waiting_payments") or (buckets and moved):
        run.put("waiting_payments", left, buckets, run.rewritten.get("_payments_changes", 0))


def adopt(spark: SparkSession, store: TableStore) -> int:
    """Lay the tables of a store of whole-snapshot loads out by bucket, so that ``load_changes`` can go on from there."""
    run = _Run(store)
    cur = store.read_all()
    if "stg_payments" not in cur or "fact_loans" not in cur:
        raise ValueError("the store holds no whole-snapshot load to start from")
    pays = cur["stg_payments"].select(*S.STG_PAYMENT_COLS)
    tables = {t: cur[t] for t in ("stg_customers", "stg_loans", "dim_customer", "dim_loan", "fact_loans")}
    tables["payment_totals"] = etl.merge_totals(None, etl.payment_totals(pays).where("loan_id IS NOT NULL"))
    tables["waiting_payments"] = pays.join(cur["fact_payments"].select("payment_id"), "payment_id", "left_anti")
    tables["loans_by_holder"] = cur["stg_loans"].where("customer_id IS NOT NULL").select("customer_id", "loan_id")
    rows = {t: run.prev[t]["row_count"] for t in run.prev}
    run.prev = {t: e for t, e in run.prev.items() if t not in tables and t not in ("stg_payments", "src_payments", "pending_payments")}
    for t, df in tables.items():
        run.put(t, df, [], rows.get(t, rows.get("stg_loans", 0)))
    return store.commit(list(run.entries.values()), run.version, keep=run.prev)


def rebucket(store: TableStore, table: str, count: int) -> int:
    """Lay a table that has grown out in ``count`` buckets: one rewrite, as a version of its own."""
    prev, version = store.manifest(), store.current_version() + 1
    e = store.write_buckets(table, store.read(table), version, key_of(table), count, key_col=etl.SK_COLS.get(table))
    return store.commit([e], version, keep=prev)
