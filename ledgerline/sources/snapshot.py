"""Table-set snapshots: export, restore, list.

``export`` writes each table of a target set (operational / warehouse /
all) as compressed Parquet under ``<root>/<label>/<table>`` plus a
manifest row per table (rows, bytes, schema, content checksum, largest surrogate
key, partitioning), and digests by key range of tables with an integer key; the manifest is written last.  The target ``resumable`` adds what
the next load or increment reads besides the warehouse's own tables.  ``restore`` refuses a snapshot whose manifest or table
files are missing, re-checks rows and checksums (a table that does not verify is named with its
faulty key ranges), and writes the tables as a new version of a store.  ``list_snapshots`` reads every manifest
and reports tables, rows and bytes per snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests as D
from .store import TableStore, path_exists, table_checksum

#: Integer keys by whose ranges tables are digested.
RANGE_KEYS = {"customers": "customer_id", "loan_products": "product_id", "loans": "loan_id", "payments": "payment_id", "dim_customer": "customer_sk",
              "dim_loan": "loan_sk", "dim_product": "product_sk", "dim_date": "date_sk", "fact_payments": "payment_sk", "fact_loans": "loan_fact_sk",
              "stg_customers": "customer_id", "stg_loans": "loan_id", "stg_payments": "payment_id", "src_payments": "payment_id"}

TARGETS = {
    "operational": ("customers", "loan_products", "loans", "payments"),
    "warehouse": ("dim_customer", "dim_loan", "dim_date", "dim_product", "dim_payment_method",
                  "fact_payments", "fact_loans"),
}
TARGETS["resumable"] = TARGETS["warehouse"] + ("stg_customers", "stg_loans", "stg_payments", "src_payments",
                                               "payment_totals", "pending_payments")
TARGETS["all"] = TARGETS["operational"] + TARGETS["warehouse"]

MANIFEST = ("table_name string, row_count long, checksum long, schema_json string, compression string, "
            "path string, bytes long, max_key long, partition_by string")


class SnapshotError(RuntimeError):
    pass


def export(spark: SparkSession, tables: dict[str, DataFrame], root: str, label: str,
           target: str = "all", compression: str = "gzip") -> DataFrame:
    """Export ``target`` tables; returns the manifest rows."""
    from ..plans.etl import SK_COLS
    from ..plans.warehouse import PARTITIONED
    names = [t for t in TARGETS[target] if t in tables]
    rows = []
    for t in names:
        path = f"{root}/{label}/{t}"
        tables[t].write.mode("errorifexists").option("compression", compression).parquet(path)
        back = spark.read.parquet(path)
        if t in RANGE_KEYS:
            # the checksum is the sum of the leaves, whose digests are kept: one pass for both
            width = D.width_for(back, RANGE_KEYS[t], 4096)
            D.leaf_digests(back, RANGE_KEYS[t], width).withColumn("width", F.lit(width).cast("long")).coalesce(1).write.mode("errorifexists") \
                .parquet(f"{root}/{label}/_digests/{t}")
            ck = _added(spark.read.parquet(f"{root}/{label}/_digests/{t}"))
        else:
            ck = table_checksum(back).first()
        key = back.agg(F.max(SK_COLS[t])).first()[0] if t in SK_COLS else None
        layout = PARTITIONED[t][0] if t in PARTITIONED and PARTITIONED[t][0] in back.columns else None
        rows.append((t, int(ck["rows"]), int(ck["checksum"]), back.schema.json(), compression, path,
                     _bytes(spark, path), key, layout))
    man = spark.createDataFrame(rows, MANIFEST)
    man.coalesce(1).write.mode("errorifexists").json(f"{root}/{label}/_manifest")
    return man


def max_compression_export(spark: SparkSession, tables: dict[str, DataFrame], root: str,
                           label: str) -> DataFrame:
    return export(spark, tables, root, label, "all", "zstd")


def read_manifest(spark: SparkSession, root: str, label: str) -> DataFrame:
    path = f"{root}/{label}/_manifest"
    if not path_exists(spark, path):
        raise SnapshotError(f"snapshot {label!r} not found under {root}")
    return spark.read.schema(MANIFEST).json(path)


def restore(spark: SparkSession, root: str, label: str, into: TableStore) -> DataFrame:
    """Restore a snapshot into a new store version after verifying it.
    Returns table_name, rows_exported, rows_restored, checksum_match."""
    man = read_manifest(spark, root, label).collect()  # one row per table
    from ..plans.etl import SK_COLS
    out, entries, faults = [], [], {}
    version = into.current_version() + 1
    prev = into.manifest()
    for m in man:
        if not path_exists(spark, m.path):
            raise SnapshotError(f"snapshot {label!r}: table {m.table_name} is missing")
        df = spark.read.parquet(m.path)
        e = into.write_table(m.table_name, df, version, partition_by=[m.partition_by] if m.partition_by else None,
                             key_col=SK_COLS.get(m.table_name))
        if e["max_key"] != m.max_key:
            raise SnapshotError(f"snapshot {label!r}: the largest key of {m.table_name} is not that of its manifest")
        entries.append(e)
        back = into.read_paths(e["new_path"], e["schema_json"]).select(*df.columns)
        kept, of = f"{root}/{label}/_digests/{m.table_name}", RANGE_KEYS.get(m.table_name)
        if of and path_exists(spark, kept):
            old = spark.read.parquet(kept)
            width = (old.agg(F.max("width")).first()[0]) or 1
            now = D.leaf_digests(back, of, width).persist()
            ck = _added(now)
            if int(ck["rows"]) != m.row_count or int(ck["checksum"]) != m.checksum:
                faults[m.table_name] = D.ranges(D.differing(old, now), width)
            now.unpersist()
        else:
            ck = table_checksum(back).first()
        out.append((m.table_name, m.row_count, int(ck["rows"]), int(ck["checksum"]) == m.checksum))
    bad = [o for o in out if not o[3] or o[1] != o[2]]
    if bad:
        named = "; ".join(f"{t}: {RANGE_KEYS[t]} " + ", ".join(f"{a}..{b}" for a, b in r) for t, r in faults.items())
        raise SnapshotError(f"snapshot {label!r} does not verify: {bad} {named}")
    into.commit(entries, version, keep=prev)
    return spark.createDataFrame(out, "table_name string, rows_exported long, rows_restored long, "
                                      "checksum_match boolean")


def _added(leaves: DataFrame):
    """Rows and checksum of a table from its leaves."""
    total = F.coalesce(F.sum(F.col("digest").cast("decimal(38,0)")), F.lit(0))
    return leaves.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                      F.pmod(total, F.lit(D.PRIME).cast("decimal(38,0)")).cast("long").alias("checksum")).first()


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots with table count, rows and bytes on storage."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "snapshot string, tables long, total_rows long, total_bytes long")
    man = spark.read.schema(MANIFEST).json(f"{root}/*/_manifest").withColumn(
        "snapshot", F.regexp_extract(F.input_file_name(), r"/([^/]+)/_manifest/", 1))
    return (man.groupBy("snapshot")
            .agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("total_rows"),
                 F.sum("bytes").alias("total_bytes")))


def _bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())

