"""Versioned Parquet table store with manifest commit.

Layout under ``root``::

    tables/<table>/store_version=<version>-<attempt>/part-*.parquet   one directory per write
    _manifests/version=<version>/part-*.json    one row per table of the version

A version becomes visible only when its manifest is written, after every
table of the run is on storage, so a run that fails half-way leaves the
previous version current (multi-table atomic commit).  Every write has a
directory of its own, so the run after a failed one never meets its files;
``vacuum`` removes what no kept version lists.  Paths being read
are never overwritten.  Everything goes through Spark's own readers and
writers, so the root may be any Hadoop-compatible shared filesystem.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = ("version long, table_name string, path string, row_count long, "
                   "schema_json string, checksum long, max_key long, layout string, committed_at timestamp_ntz")
#: The partition column of tables laid out by hash bucket.
BUCKET = "_bucket"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path's scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def table_checksum(df: DataFrame) -> DataFrame:
    """Order-independent content checksum (sum of row hashes) and row count."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(h.cast("decimal(38,0)")) % F.lit(2**61 - 1), F.lit(0)).cast("long")
                  .alias("checksum"))


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._manifest_cache: dict[int, dict[str, dict]] = {}
        self._current: int | None = None

    # ----------------------------------------------------------- paths
    def table_path(self, table: str, version: int) -> str:
        """A directory that no other write uses, also not a failed attempt at the same version."""
        return f"{self.root}/tables/{table}/store_version={version}-{uuid.uuid4().hex[:12]}"

    @property
    def manifest_root(self) -> str:
        return f"{self.root}/_manifests"

    # -------------------------------------------------------- manifests
    def manifests(self) -> DataFrame | None:
        if not path_exists(self.spark, self.manifest_root):
            return None
        return self.spark.read.schema(MANIFEST_SCHEMA.replace(", committed_at timestamp_ntz",
                                                              ", committed_at string")) \
            .json(self.manifest_root)

    def current_version(self) -> int:
        if self._current is not None:
            return self._current
        m = self.manifests()
        if m is None:
            return 0
        v = m.agg(F.max("version")).first()[0]
        self._current = int(v or 0)
        return self._current

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Manifest rows of a version (one small row per table)."""
        version = self.current_version() if version is None else version
        if version in self._manifest_cache:
            return self._manifest_cache[version]
        m = self.manifests()
        if m is None or version == 0:
            return {}
        rows = m.where(F.col("version") == version).collect()
        out = {r.table_name: r.asDict() for r in rows}
        self._manifest_cache[version] = out
        return out

    # ------------------------------------------------------------ read
    def read_paths(self, path: str, schema_json: str | None = None) -> DataFrame:
        """Read a manifest path list with the recorded schema (no
        inference).  Several version directories of one table are read
        under the table folder as base path, so partition columns inside
        them (e.g. ``payment_year``) are discovered; the version column
        that base path adds is dropped."""
        paths = path.split(",")
        reader = self.spark.read
        if schema_json:
            reader = reader.schema(schema_of({"schema_json": schema_json}))
        if len(paths) == 1:
            return reader.parquet(paths[0])
        base = paths[0].rsplit("/", 1)[0]
        df = reader.option("basePath", base).parquet(*paths)
        return df.drop("store_version")

    def read_entry(self, entry: dict) -> DataFrame:
        by_bucket = entry.get("layout") and "buckets" in json.loads(entry["layout"])
        return self.read_buckets(entry) if by_bucket else self.read_paths(entry["path"], entry.get("schema_json"))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        entry = self.manifest(version).get(table)
        if entry is None:
            return None
        return self.read_entry(entry)

    def read_all(self, version: int | None = None) -> dict[str, DataFrame]:
        return {t: self.read_entry(e) for t, e in self.manifest(version).items()}

    # --------------------------------------------- tables by hash bucket
    def read_buckets(self, entry: dict, only: list[int] | None = None) -> DataFrame:
        """A table by hash bucket, or the buckets ``only`` of it: no other directory is listed or read."""
        layout, schema = json.loads(entry["layout"]), schema_of(entry)
        paths = [p for b, (p, _) in layout["buckets"].items() if only is None or int(b) in set(only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/tables/{entry['table_name']}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def write_buckets(self, table: str, df: DataFrame, version: int, key: str, buckets: int, into: dict | None = None,
                      touched: list[int] | None = None, metrics: dict | None = None, drop: list[str] | None = None,
                      key_col: str | None = None, by: Column | None = None) -> dict:
        """Write the rows of the ``touched`` buckets (None: of all) and carry the others of ``into`` over.

        A row's bucket is a hash of ``key``, or ``by`` (an integer).  The manifest entry lists one directory and its rows per bucket, so
        a write costs the buckets it touches and the entry's size is bounded by their number.  ``df`` holds
        all rows that the touched buckets have from now on.
        """
        path = self.table_path(table, version)
        obs, metrics = Observation(f"b_{table}_{uuid.uuid4().hex[:8]}"), dict(metrics or {})
        if key_col:
            metrics["max_key"] = F.max(key_col)
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
        observed = observed.drop(*[c for c in (drop or []) if c in df.columns])
        schema = observed.schema
        # a rebalance by bucket makes few files a bucket, and splits a large one
        observed.withColumn(BUCKET, bucket_of(key, buckets) if by is None else by).hint("rebalance", F.col(BUCKET)).write.mode("errorifexists") \
            .option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        got = obs.get
        held = {}
        if got["rows"]:
            folder = lambda b: "__HIVE_DEFAULT_PARTITION__" if b is None else b
            held = {str(r[BUCKET]): [f"{path}/{BUCKET}={folder(r[BUCKET])}", r["n"]] for r in self.spark.read.schema(schema).parquet(path)
                    .groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}               # one row per bucket
        if into is not None and touched is not None:
            gone = {str(b) for b in touched}
            held |= {b: e for b, e in json.loads(into["layout"])["buckets"].items() if b not in gone}
        extra = {k: got.get(k) for k in metrics}
        keys = [k for k in (extra.get("max_key"), (into or {}).get("max_key")) if k is not None]
        return {"table_name": table, "path": ",".join(p for p, _ in held.values()), "new_path": path, "new_rows": int(got["rows"]),
                "row_count": sum(n for _, n in held.values()), "schema_json": schema.json(), "metrics": extra,
                "max_key": max(keys) if keys else None, "layout": json.dumps({"key": key, "count": buckets, "buckets": held})}

    # ----------------------------------------------------------- write
    def write_table(self, table: str, df: DataFrame, version: int, compression: str = "zstd",
                    partition_by: list[str] | None = None, append_to: dict | None = None,
                    metrics: dict | None = None, drop: list[str] | None = None,
                    key_col: str | None = None) -> dict:
        """Write one table version.  With ``append_to`` (the previous
        manifest entry) only the new rows are written and the entry lists
        the old files plus the new directory: appends cost O(increment).
        ``metrics`` are extra aggregate columns observed during the write;
        ``drop`` columns are removed before writing."""
        obs = Observation(f"w_{table}_{version}")
        path = self.table_path(table, version)
        metrics = dict(metrics or {})
        if key_col:
            metrics["max_key"] = F.max(key_col)
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                              *[c.alias(k) for k, c in (metrics or {}).items()])
        observed = observed.drop(*[c for c in (drop or []) if c in df.columns])
        w = observed.write.mode("errorifexists").option("compression", compression)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        got = obs.get
        rows = int(got["rows"])
        schema_json = observed.schema.json()
        extra = {k: got.get(k) for k in metrics}
        max_key = extra.get("max_key")
        if append_to is not None:
            keys = [k for k in (max_key, append_to.get("max_key")) if k is not None]
            # an empty increment adds no directory to the table
            paths = append_to["path"] + "," + path if rows else append_to["path"]
            return {"table_name": table, "path": paths, "new_path": path,
                    "row_count": int(append_to["row_count"]) + rows, "new_rows": rows,
                    "schema_json": schema_json, "metrics": extra, "max_key": max(keys) if keys else None}
        return {"table_name": table, "path": path, "new_path": path, "row_count": rows, "new_rows": rows,
                "schema_json": schema_json, "metrics": extra, "max_key": max_key}

    def commit(self, entries: list[dict], version: int, keep: dict[str, dict] | None = None,
               checksums: bool = False) -> int:
        """Write the manifest of ``version``: new entries plus unchanged
        tables carried over from ``keep`` (the previous manifest).  One
        writer per store is assumed (the load is the only writer)."""
        rows = {e["table_name"]: e for e in (keep or {}).values()}
        for e in entries:
            rows[e["table_name"]] = e
        out = []
        for t, e in sorted(rows.items()):
            ck = e.get("checksum")
            if checksums and ck is None:
                ck = table_checksum(self.read_entry(e)).first()["checksum"]
            mk = e.get("max_key")
            out.append((version, t, e["path"], int(e["row_count"]), e["schema_json"],
                        None if ck is None else int(ck), None if mk is None else int(mk), e.get("layout")))
        df = self.spark.createDataFrame(
            out, "version long, table_name string, path string, row_count long, schema_json string, "
                 "checksum long, max_key long, layout string").withColumn("committed_at",
                                                           F.current_timestamp().cast("timestamp_ntz"))
        # the version is the directory's partition value, not a field
        df.drop("version").coalesce(1).write.mode("errorifexists") \
            .json(f"{self.manifest_root}/version={version}")
        self._current = version
        self._manifest_cache[version] = {
            r[1]: {"version": r[0], "table_name": r[1], "path": r[2], "row_count": r[3], "schema_json": r[4],
                   "checksum": r[5], "max_key": r[6], "layout": r[7], "committed_at": None} for r in out}
        return version

    def compact(self, table: str, partition_by: list[str] | None = None,
                max_records_per_file: int = 5_000_000, order_by: list[str] | None = None) -> int:
        """Rewrite an appended table (many version directories) into one
        new version directory and commit it; other tables carry over.
        Readers of the previous version are unaffected (nothing is
        overwritten)."""
        prev = self.manifest()
        entry = prev[table]
        if entry.get("layout") or "," not in entry["path"]:
            return self.current_version()
        df = self.read_paths(entry["path"], entry.get("schema_json"))
        version = self.current_version() + 1
        path = self.table_path(table, version)
        if partition_by:
            # range-partition on (partition cols, order cols): each task writes
            # few partition folders, and a hot year is split over many tasks
            df = df.repartitionByRange(*partition_by, *(order_by or []))
        w = df.write.mode("errorifexists").option("maxRecordsPerFile", max_records_per_file)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        new = dict(entry, path=path)
        return self.commit([new], version, keep=prev)

    def vacuum(self, keep: int = 2) -> int:
        """Delete table directories that none of the newest ``keep`` versions lists, and the older versions'
        manifests; returns how many table directories.

        No load may run meanwhile: its directories are not listed yet.
        """
        newest = range(max(1, self.current_version() - keep + 1), self.current_version() + 1)
        listed = {p.rpartition("/tables/")[2].partition(f"/{BUCKET}=")[0]
                  for v in newest for e in self.manifest(v).values() for p in e["path"].split(",")}
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/tables/*/store_version=*")
        fs = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for status in fs.globStatus(pattern):
            if status.getPath().toString().rpartition("/tables/")[2] not in listed:
                fs.delete(status.getPath(), True)
                gone += 1
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.manifest_root}/version=*")):
            v = int(status.getPath().getName().partition("=")[2])
            if v < newest.start:
                fs.delete(status.getPath(), True)
                self._manifest_cache.pop(v, None)
        return gone

    def write_version(self, tables: dict[str, DataFrame], compression: str = "zstd",
                      partition_by: dict[str, list[str]] | None = None,
                      checksums: bool = False) -> int:
        prev = self.manifest()
        version = self.current_version() + 1
        entries = [self.write_table(t, df, version, compression, (partition_by or {}).get(t))
                   for t, df in tables.items()]
        return self.commit(entries, version, keep=prev, checksums=checksums)


def bucket_of(key: str, buckets: int):
    """The hash bucket of a key column."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that hold the keys: at most ``buckets`` numbers."""
    return sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())


def schema_of(entry: dict):
    from pyspark.sql.types import StructType
    return StructType.fromJson(json.loads(entry["schema_json"]))
