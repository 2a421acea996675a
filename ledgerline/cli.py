"""Command line: run the load, the micro-batch stream, snapshots, history.

    python -m ledgerline.cli load      --source DIR --store DIR [--run-ts TS]
    python -m ledgerline.cli stream    --landing DIR --source DIR --store DIR [--every "15 minutes"]
    python -m ledgerline.cli export    --store DIR --snapshots DIR --label L [--target all] [--zstd]
    python -m ledgerline.cli restore   --snapshots DIR --label L --store DIR
    python -m ledgerline.cli snapshots --snapshots DIR
    python -m ledgerline.cli history   --store DIR
    python -m ledgerline.cli compact   --store DIR [--table fact_payments]

``--source`` holds one Parquet folder per source table (customers,
loan_products, loans, payments) read with the declared schemas.  The
session comes from spark-submit / the environment; nothing here creates
cluster settings of its own.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.runlog import RunLog, run_history
from .plans import warehouse as WH
from .plans.etl import SK_COLS as SK
from .session import apply_core_conf
from .sources import schemas as S
from .sources import snapshot as SN
from .sources.readers import jdbc_options, read_jdbc, read_typed
from .sources.store import TableStore

SOURCE_DEFAULTS = {"customers": S.CUSTOMER_DEFAULTS, "loans": S.LOAN_DEFAULTS, "payments": S.PAYMENT_DEFAULTS,
                   "loan_products": S.PRODUCT_DEFAULTS}
SOURCE_SCHEMAS = {"customers": S.CUSTOMERS, "loan_products": S.LOAN_PRODUCTS, "loans": S.LOANS,
                  "payments": S.PAYMENTS}


def read_sources(spark: SparkSession, root: str) -> dict:
    return {t: read_typed(spark, f"{root.rstrip('/')}/{t}", sch, defaults=SOURCE_DEFAULTS[t])
            for t, sch in SOURCE_SCHEMAS.items()}


def parents(spark: SparkSession, root: str) -> dict:
    """The tables besides payments, as they are now."""
    return {t: read_typed(spark, f"{root.rstrip('/')}/{t}", sch, defaults=SOURCE_DEFAULTS[t])
            for t, sch in SOURCE_SCHEMAS.items() if t != "payments"}


def read_database(spark: SparkSession, bounds: list[str]) -> dict:
    """The source tables over JDBC, with the connection of the session conf or the environment.

    ``bounds``: ``table=column:lower:upper:partitions`` reads a table in parallel ranges; the others over one connection.
    """
    options = jdbc_options(spark)
    ranges = dict(b.split("=", 1) for b in bounds)
    unknown = set(ranges) - set(SOURCE_SCHEMAS)
    if unknown:
        raise ValueError(f"no such source table: {', '.join(sorted(unknown))}")
    out = {}
    for t, sch in SOURCE_SCHEMAS.items():
        if t in ranges:
            column, lower, upper, n = ranges[t].split(":")
            out[t] = read_jdbc(spark, t, sch, options, column, int(lower), int(upper), int(n))
        else:
            out[t] = read_jdbc(spark, t, sch, options)
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerline")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("load")
    p.add_argument("--source", help="folder with a Parquet table each; without it the source is the JDBC database")
    p.add_argument("--bounds", action="append", default=[], help="JDBC: table=column:lower:upper:partitions")
    p.add_argument("--store", required=True)
    p.add_argument("--gate", action="store_true", help="refuse the run if a payment breaks a declared rule")
    p.add_argument("--run-ts")
    p = sub.add_parser("stream")
    p.add_argument("--landing", required=True)
    p.add_argument("--source", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--files-per-trigger", type=int, default=None, help="default: all that are there")
    p.add_argument("--every", default=None, help="processing-time trigger, e.g. '15 minutes'")
    p = sub.add_parser("export")
    p.add_argument("--store", required=True)
    p.add_argument("--snapshots", required=True)
    p.add_argument("--label", required=True)
    p.add_argument("--target", default="resumable", choices=sorted(SN.TARGETS))
    p.add_argument("--zstd", action="store_true")
    p = sub.add_parser("restore")
    p.add_argument("--snapshots", required=True)
    p.add_argument("--label", required=True)
    p.add_argument("--store", required=True)
    p = sub.add_parser("snapshots")
    p.add_argument("--snapshots", required=True)
    p = sub.add_parser("history")
    p.add_argument("--store", required=True)
    p = sub.add_parser("compact")
    p.add_argument("--store", required=True)
    p.add_argument("--table", default="fact_payments")
    p = sub.add_parser("vacuum")
    p.add_argument("--store", required=True)
    p.add_argument("--keep", type=int, default=2, help="versions to keep")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"ledgerline-{a.cmd}").getOrCreate()
    apply_core_conf(spark)
    if getattr(a, "store", None) and not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(a.store.rstrip("/") + "/_scratch")       # the store is on shared storage
    if a.cmd == "load":
        src = read_sources(spark, a.source) if a.source else read_database(spark, a.bounds)
        print(WH.load(spark, TableStore(spark, a.store), src, a.run_ts, gate=a.gate))
    elif a.cmd == "stream":
        from .streaming.microbatch import payment_stream
        trigger = {"processingTime": a.every} if a.every else {"availableNow": True}
        q = payment_stream(spark, a.landing, S.PAYMENTS, TableStore(spark, a.store), lambda: parents(spark, a.source),
                           a.store.rstrip("/") + "/_stream_checkpoint", trigger=trigger, files_per_trigger=a.files_per_trigger)
        q.awaitTermination()
    elif a.cmd == "export":
        tables = TableStore(spark, a.store).read_all()
        SN.export(spark, tables, a.snapshots, a.label, a.target, "zstd" if a.zstd else "gzip").show(truncate=False)
    elif a.cmd == "restore":
        SN.restore(spark, a.snapshots, a.label, TableStore(spark, a.store)).show(truncate=False)
    elif a.cmd == "snapshots":
        SN.list_snapshots(spark, a.snapshots).show(truncate=False)
    elif a.cmd == "history":
        run_history(RunLog(spark, a.store).runs()).show(truncate=False)
    elif a.cmd == "vacuum":
        print(TableStore(spark, a.store).vacuum(a.keep))
    elif a.cmd == "compact":
        parts = [WH.PARTITIONED[a.table][0]] if a.table in WH.PARTITIONED else None
        order = [SK.get(a.table)] if SK.get(a.table) else None
        print(TableStore(spark, a.store).compact(a.table, parts, order_by=order))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
