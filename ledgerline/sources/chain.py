"""Snapshots as a chain: an export copies only what no earlier snapshot of the chain holds.

A store never changes a directory that it has written, so a directory (of one
write, or of one bucket of it) is the unit: an export lists every directory of
the version and copies those that the chain lacks, all new ones of a table in one job.
A snapshot is a manifest of such parts, old and new, with rows and checksum of each; restore goes
through them and verifies every part; expiry drops old manifests and the parts
that no other one lists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshot import SnapshotError
from .store import BUCKET, TableStore, path_exists, schema_of

PARTS = ("table_name string, part string, path string, rows long, checksum long, schema_json string, layout string, "
         "partition_by string, max_key long, copied boolean")
VERSION = "store_version"


class SnapshotChain:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ what it holds
    def snapshots(self) -> list[str]:
        """Labels, oldest first."""
        path = f"{self.root}/_chain"
        if not path_exists(self.spark, path):
            return []
        names = self.spark.read.schema("label string, seq long").json(f"{path}/*/label").orderBy("seq").collect()     # one row per snapshot
        return [r["label"] for r in names]

    def manifest(self, label: str) -> DataFrame:
        if label not in self.snapshots():
            raise SnapshotError(f"snapshot {label!r} not found under {self.root}")
        return self.spark.read.schema(PARTS).json(f"{self.root}/_chain/{label}/parts")

    def _known(self) -> DataFrame:
        labels = self.snapshots()
        if not labels:
            return self.spark.createDataFrame([], PARTS)
        return self.spark.read.schema(PARTS).json([f"{self.root}/_chain/{x}/parts" for x in labels]).dropDuplicates(["table_name", "part"])

    # ------------------------------------------------------------------- export
    def export(self, store: TableStore, label: str, tables: tuple[str, ...] | None = None, version: int | None = None,
               compression: str = "zstd") -> DataFrame:
        """Add a snapshot of a store's version; returns per table its rows and how many of them were copied now."""
        labels = self.snapshots()
        if label in labels:
            raise SnapshotError(f"snapshot {label!r} exists")
        known = {(r["table_name"], r["part"]): r.asDict() for r in self._known().collect()}       # one row per directory of the chain
        rows = []
        for t, e in sorted(store.manifest(version).items()):
            if tables is not None and t not in tables:
                continue
            parts = {p.rpartition(f"/tables/{t}/")[2]: p for p in e["path"].split(",") if p}
            new = {n: p for n, p in parts.items() if (t, n) not in known}
            copied = self._copy(store, t, e, new, compression) if new else {}
            layout = json.loads(e["layout"]) if e.get("layout") else {}
            layout = json.dumps({k: layout[k] for k in ("key", "count") if k in layout}) if "buckets" in layout else None
            year = _partitioned(e)
            for n in parts:
                own = copied.get(n) or known.get((t, n))
                if own is None:                                          # a directory without rows
                    continue
                rows.append((t, n, own["path"], own["rows"], own["checksum"], e["schema_json"], layout, year, e.get("max_key"), n in copied))
            if not any(r[0] == t for r in rows):
                rows.append((t, "", "", 0, 0, e["schema_json"], layout, year, e.get("max_key"), False))
        base = f"{self.root}/_chain/{label}"
        self.spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("errorifexists").json(f"{base}/parts")
        # the label is written last: without it the snapshot does not exist
        self.spark.createDataFrame([(label, len(labels))], "label string, seq long").coalesce(1).write.mode("errorifexists").json(f"{base}/label")
        return self.summary(label)

    def _copy(self, store: TableStore, table: str, entry: dict, new: dict[str, str], compression: str) -> dict[str, dict]:
        """Copy directories of a table in one job; rows and checksum of each."""
        by_bucket = BUCKET in next(iter(new))
        keys = [VERSION, BUCKET] if by_bucket else [VERSION]
        schema = T.StructType([*schema_of(entry).fields, T.StructField(VERSION, T.StringType()), *([T.StructField(BUCKET, T.StringType())] if by_bucket else [])])
        dest = f"{self.root}/parts/{table}/{uuid.uuid4().hex[:12]}"
        df = self.spark.read.schema(schema).option("basePath", f"{store.root}/tables/{table}").parquet(*new.values())
        df.write.mode("errorifexists").option("compression", compression).partitionBy(*keys).parquet(dest)
        back = self.spark.read.schema(schema).parquet(dest)
        out = {}
        for r in _checksums(back, keys, schema_of(entry).names).collect():                           # one row per directory
            name = "/".join(f"{k}={r[k]}" for k in keys)
            out[name] = {"path": f"{dest}/{name}", "rows": r["rows"], "checksum": r["checksum"]}
        return out

    def summary(self, label: str) -> DataFrame:
        return self.manifest(label).groupBy("table_name").agg(
            F.sum("rows").alias("row_count"), F.sum(F.when(F.col("copied"), F.col("rows")).otherwise(0)).alias("copied_rows"))

    # ------------------------------------------------------------------ restore
    def restore(self, label: str, into: TableStore) -> DataFrame:
        """Commit the snapshot's tables as a new version of a store, after every part has been verified."""
        held: dict[str, list] = {}
        for r in self.manifest(label).collect():
            held.setdefault(r["table_name"], []).append(r)
        from ..plans.etl import SK_COLS
        version, prev, entries, out = into.current_version() + 1, into.manifest(), [], []
        for t, parts in sorted(held.items()):
            schema, first = T.StructType.fromJson(json.loads(parts[0]["schema_json"])), parts[0]
            paths = [p["path"] for p in parts if p["path"]]
            gone = [p for p in paths if not path_exists(self.spark, p)]
            if gone:
                raise SnapshotError(f"snapshot {label!r}: {t} lacks {gone[0]}")
            df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            faulty = self._faulty(df, parts, schema) if paths else []
            if faulty:
                raise SnapshotError(f"snapshot {label!r}: {t} does not verify: {', '.join(faulty)}")
            layout, sk = json.loads(first["layout"]) if first["layout"] else None, SK_COLS.get(t)
            if layout:
                e = into.write_buckets(t, df, version, layout["key"], layout["count"], key_col=sk)
            else:
                e = into.write_table(t, df, version, partition_by=[first["partition_by"]] if first["partition_by"] else None, key_col=sk)
            if first["max_key"] is not None and e["max_key"] is None:
                e["max_key"] = first["max_key"]
            entries.append(e)
            out.append((t, sum(p["rows"] for p in parts), e["row_count"]))
        into.commit(entries, version, keep=prev)
        return self.spark.createDataFrame(out, "table_name string, rows_exported long, rows_restored long")

    @staticmethod
    def _faulty(df: DataFrame, parts: list, schema: T.StructType) -> list[str]:
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        # the same directory whatever scheme its path is written with
        tail = F.regexp_extract(folder, r"/parts/[^/]+/([0-9a-f]{12}/.*)$", 1)
        found = {r["part"]: r for r in _checksums(df.select(*schema.names, tail.alias("part")), ["part"], schema.names).collect()}
        out = []
        for p in parts:
            got = found.get(p["path"].rpartition("/parts/")[2].partition("/")[2])
            if got is None or (got["rows"], got["checksum"]) != (p["rows"], p["checksum"]):
                out.append(p["part"])
        return out

    # ------------------------------------------------------------------- expiry
    def expire(self, keep: int) -> int:
        """Drop all but the newest ``keep`` snapshots, and the parts that none of the kept ones lists; returns how many parts."""
        labels = self.snapshots()
        old = labels[:max(0, len(labels) - keep)]
        if not old:
            return 0
        mine = F.min(F.col("label").isin(old)).over(Window.partitionBy("path"))
        all_parts = None
        for x in labels:
            m = self.manifest(x).select("path", F.lit(x).alias("label"))
            all_parts = m if all_parts is None else all_parts.unionByName(m)
        gone = [r["path"] for r in all_parts.withColumn("only_old", mine).where("only_old AND path != ''").select("path").distinct().collect()]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        # manifests go first: what is left over after a failure is only unlisted
        for p in [f"{self.root}/_chain/{x}" for x in old] + gone:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        return len(gone)


def _checksums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and order-independent checksum of each group."""
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                 F.pmod(F.sum(h), F.lit(2 ** 61 - 1).cast("decimal(38,0)")).cast("long").alias("checksum"))


def _partitioned(entry: dict) -> str | None:
    from ..plans.warehouse import PARTITIONED
    name = PARTITIONED.get(entry["table_name"], (None,))[0]
    return name if name in schema_of(entry).names else None
