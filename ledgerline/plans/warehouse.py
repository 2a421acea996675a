"""Run the load against a versioned store and keep a run log.

``load`` = open run -> stage -> dimensions -> facts -> write every table
of the version -> commit manifest -> close run.  Appends (fact_payments)
write only the new rows; upserted tables write their next version.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as DQ
from ..operators.keys import layouts
from ..operators.runlog import RunLog
from ..operators.upsert import ConflictingRowsError, DuplicateKeyError, insert_absent, one_per_key
from ..session import remove_path, scratch_path, shuffles_released, small_splits
from ..sources import schemas as S
from ..sources import testdata
from ..sources.store import TableStore
from .etl import SK_COLS, merge_totals, payment_totals, run_load

# Run clock used by tests and by the registered queries (a parameter, so
# results are reproducible; production passes the wall clock).
FIXED_RUN_TS = "2030-01-01 00:00:00"
SECOND_RUN_TS = "2030-01-02 00:00:00"

STATIC_TABLES = ("dim_date", "dim_payment_method")

# Payment facts are partitioned by payment year (from the YYYYMMDD key):
# time-bounded questions prune whole years at the scan.
PARTITIONED = {"fact_payments": ("payment_year", "CAST(date_sk DIV 10000 AS INT)")}


def _now():
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


APPEND_TABLES = ("fact_payments", "src_payments")
#: A run's scratch tables, by the table that reads them last.
LAST_READ = {"fact_payments": "_payment_candidates", "fact_loans": "_loan_context", "pending_payments": "_pending_before"}
#: What increments keep between runs.  A load of whole snapshots drops them: its staged payments
#: are the accumulated source from which the next increment starts.
INCREMENT_TABLES = ("src_payments", "payment_totals", "pending_payments")
#: What the load of changes (``plans.delta``) keeps besides; a load of whole snapshots drops them.
CHANGE_TABLES = ("waiting_payments", "loans_by_holder")


#: Row rules of a payment batch; a loan that is not there yet is no fault, the payment waits for it.
GATE_RULES = [r for r in DQ.DOMAIN + DQ.RANGE + DQ.NOT_NULL if r.table == "payments"]


class BatchRejected(ValueError):
    pass


def load(spark: SparkSession, store: TableStore, src: dict[str, DataFrame], run_ts: str | None = None,
         batch_id: int | None = None, log: RunLog | None = None, check_keys: bool = True,
         increment: bool = False, customer_history: bool = False, gate: bool = False) -> dict:
    """One ETL run; returns the run metrics.  Raises after logging a failure.

    Each table is written once and read back by the later steps.  Row
    counts come from metrics observed while writing (no extra jobs).
    The manifest is committed last: a failure leaves the previous
    version current and the run is logged as failed.

    ``increment=True`` (micro-batches): ``src["payments"]`` holds only new
    source rows.  They are appended to ``src_payments`` (insert-if-absent
    by id), their per-loan totals are folded into ``payment_totals``, and
    the run stages the batch plus the payments still pending from earlier
    runs (parent not seen yet).  Payments that come twice, in one batch or
    again later, count once; new payments of one id that differ refuse the batch.  The first increment after a load of whole
    snapshots takes that load's staged payments as its start.  Every table of the step commits in the
    same manifest, so the cost per batch is O(batch + loan grain) and the
    result equals a full re-extract.

    Shuffles go when their query ends, layouts of dense keys and the run's
    scratch tables once the table that reads them is written.
    """
    log = log or RunLog(spark, store.root)
    prev = store.manifest()
    version = store.current_version() + 1
    started = _now()
    run_ts = run_ts or started.strftime("%Y-%m-%d %H:%M:%S")
    run_id = log.next_run_id()                  # its own: a failed run leaves the version as it was
    log.open(run_id, started, batch_id)
    entries: dict[str, dict] = {}
    ops: dict[str, dict] = {}
    scratch: dict[str, str] = {}
    scope = contextlib.ExitStack()
    scope.enter_context(shuffles_released(spark))
    written = scope.enter_context(layouts(spark))

    def sink(name: str, df: DataFrame) -> DataFrame:
        append = entries.get(name) or prev.get(name) if name in APPEND_TABLES else None
        partition_by = None
        if name in PARTITIONED:
            col, expr = PARTITIONED[name]
            df = df.withColumn(col, F.expr(expr))
            partition_by = [col]
        metrics = {}
        if "_op" in df.columns:
            for op in ("insert", "update"):
                metrics[op] = F.sum(F.when(F.col("_op") == op, 1).otherwise(0))
        if "_dup" in df.columns:
            metrics["max_dup"] = F.max("_dup")
        if "_conflict" in df.columns:
            metrics["conflicts"] = F.sum("_conflict")
        e = store.write_table(name, df, version, append_to=append, metrics=metrics, drop=["_op", "_dup", "_conflict"],
                              key_col=SK_COLS.get(name), partition_by=partition_by)
        written(SK_COLS.get(name))
        if check_keys and (e["metrics"].get("max_dup") or 0) > 1:
            # an upsert batch may not hold one key twice: refuse before commit
            raise DuplicateKeyError(f"{name}: the batch holds a key more than once")
        if e["metrics"].get("conflicts"):
            # a primary key would refuse the second of two rows that differ; which of them is right is not known here
            raise ConflictingRowsError(f"{name}: {e['metrics']['conflicts']} keys have rows that differ")
        if name.startswith("_"):  # '_' tables are run scratch, not committed
            scratch[name] = e["new_path"]
        else:
            entries[name] = e
        if LAST_READ.get(name) in scratch:
            remove_path(spark, scratch.pop(LAST_READ[name]))
        ops[name] = e.get("metrics", {})
        return store.read_paths(e["new_path"], e["schema_json"])

    try:
        if gate:                                # all or nothing: one faulty payment refuses the batch
            n = DQ.check(src["payments"], GATE_RULES, ["payment_id"], table="payments")[1].count()
            if n:
                raise BatchRejected(f"{n} payments break a declared rule")
        current = store.read_all() if prev else None
        # current max surrogate keys, recorded by the previous commit
        starts = {t: (int(e["max_key"]) if e.get("max_key") is not None else 0)
                  for t, e in prev.items() if t in SK_COLS}
        totals = None
        if increment and any(t in prev for t in CHANGE_TABLES):
            raise ValueError("the store is loaded by changes: go on with load_changes, or load whole snapshots")
        if increment:
            cur = current or {}
            known, paid, pending = (cur.get(t) for t in INCREMENT_TABLES)
            if known is None and "fact_payments" in cur and "stg_payments" not in cur:
                raise ValueError("the store holds facts but no payments to add to: load whole snapshots first")
            if known is None and "stg_payments" in cur:
                known = sink("src_payments", cur["stg_payments"].select(*S.STG_PAYMENT_COLS))
                paid = merge_totals(None, payment_totals(known))
                # read by the stage and at the end
                pending = sink("_pending_before", known.join(cur["fact_payments"].select("payment_id"), "payment_id", "left_anti"))
            batch = one_per_key(src["payments"].select(*S.STG_PAYMENT_COLS), "payment_id")
            _, fresh = insert_absent(known, batch, "payment_id")
            fresh = sink("src_payments", fresh)
            totals = sink("payment_totals", merge_totals(paid, payment_totals(fresh)))
            staged = fresh if pending is None else fresh.unionByName(pending.select(*fresh.columns))
            src = {**src, "payments": staged}
        with small_splits(spark):
            res = run_load(spark, current, src, run_ts, sink, starts if prev else None, pay_totals=totals,
                           customer_history=customer_history, refuse_repeats=check_keys)
        if increment:
            # still waiting for their loan / customer: retried next batch
            sink("pending_payments",
                 src["payments"].join(res.new_payments.select("payment_id"), "payment_id", "left_anti"))
        new_pay = entries["fact_payments"]["new_rows"]
        fl = ops["fact_loans"]
        metrics = {
            "payments_inserted": new_pay,
            # rows_inserted / rows_updated keep the source system's definitions:
            # new payments + every upserted loan row; extracted customers + loans.
            "rows_inserted": new_pay + int(fl["insert"] or 0) + int(fl["update"] or 0),
            "rows_updated": entries["stg_customers"]["row_count"] + entries["stg_loans"]["row_count"],
            "loans_inserted": int(fl["insert"] or 0),
            "loans_updated": int(fl["update"] or 0),
            "version": version,
        }
        keep = prev if increment else {t: e for t, e in prev.items() if t not in INCREMENT_TABLES + CHANGE_TABLES}
        store.commit(list(entries.values()), version, keep=keep)
    except Exception as exc:  # record, then re-raise
        log.close(run_id, started, _now(), "failed", error=str(exc), batch_id=batch_id)
        raise
    finally:
        scope.close()
    log.close(run_id, started, _now(), "success", metrics, batch_id=batch_id)
    fold_reports(spark, store)
    return metrics


def fold_reports(spark: SparkSession, store: TableStore) -> None:
    """Carry the stored reports forward, where the store keeps any (``maintained.refresh`` starts them)."""
    from . import maintained
    if maintained.SUPPORT in store.manifest():
        maintained.refresh(spark, store)


# ------------------------------------------------- per-session warehouses
_CACHE: dict[tuple, TableStore] = {}


def _key(spark: SparkSession, *parts) -> tuple:
    return (spark.sparkContext.applicationId, *parts)


def built(spark: SparkSession, sf_dir: str, scenario: str = "full") -> TableStore:
    """Warehouse of the driver's tables, loaded once per session.

    ``full``        one run over all source rows
    ``incremental`` run 1 over the first snapshot, run 2 over everything
    ``first``       only run 1 of the incremental scenario
    """
    k = _key(spark, sf_dir, scenario)
    if k in _CACHE:
        return _CACHE[k]
    root = scratch_path(spark, "warehouse", uuid.uuid4().hex)
    store = TableStore(spark, root)
    src = operational(spark, sf_dir)
    if scenario == "full":
        load(spark, store, src, FIXED_RUN_TS)
    else:
        load(spark, store, testdata.first_snapshot(src), FIXED_RUN_TS)
        if scenario == "incremental":
            load(spark, store, testdata.second_snapshot(src), SECOND_RUN_TS)
    _CACHE[k] = store
    return store


def tables(spark: SparkSession, sf_dir: str, scenario: str = "full") -> dict[str, DataFrame]:
    return built(spark, sf_dir, scenario).read_all()


def operational(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The operational source tables (mapped from the driver's tables),
    written once per session so every view and load reads Parquet."""
    k = _key(spark, sf_dir, "operational")
    if k not in _CACHE:
        store = TableStore(spark, scratch_path(spark, "operational", uuid.uuid4().hex))
        with small_splits(spark), shuffles_released(spark):
            store.write_version(testdata.source_tables(spark, sf_dir))
        _CACHE[k] = store
    return _CACHE[k].read_all()

