"""Spark session helpers.

The library never creates a session behind the caller's back: every
operator takes the caller's ``SparkSession``.  ``local_session`` is for
tests, the bench and command-line use.
"""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on (UTC dates, AQE re-plans).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerline") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_core_conf(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    for k, v in CORE_CONF.items():
        spark.conf.set(k, v)


#: Bytes of input that a task of a load reads at most: what it sorts or groups then stays in memory.
LOAD_SPLIT = 32 << 20
#: Partitions that a load's shuffles start from at least (Spark's own default): AQE merges small ones, but can't split those that are sorted.
LOAD_PARTITIONS = 200


@contextlib.contextmanager
def small_splits(spark: SparkSession):
    """Scans of the block in splits of at most LOAD_SPLIT bytes, shuffles from LOAD_PARTITIONS partitions on
    (a smaller split, or more partitions, stay as they are)."""
    split, first = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = {split: spark.conf.get(split), first: spark.conf.get(first, None)}
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    text = own[split].lower().rstrip("b") or "0"
    held = int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)
    try:
        if held > LOAD_SPLIT:
            spark.conf.set(split, str(LOAD_SPLIT))
        if int(own[first] or spark.conf.get("spark.sql.shuffle.partitions")) < LOAD_PARTITIONS:
            spark.conf.set(first, str(LOAD_PARTITIONS))
        yield
    finally:
        for name, value in own.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: With this set, Spark removes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that end in the block leave no shuffle files behind (one that is run a second time makes them anew)."""
    own = spark.conf.get(RELEASE_SHUFFLES, None)
    try:
        spark.conf.set(RELEASE_SHUFFLES, "true")
        yield
    finally:
        spark.conf.unset(RELEASE_SHUFFLES) if own is None else spark.conf.set(RELEASE_SHUFFLES, own)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) as the
    cluster names it.  Only in local mode, where there are no other machines,
    a private folder is created and registered when nothing is configured.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if not cur:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf:
            sc.setCheckpointDir(conf)
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-ckpt-"))
        cur = sc.getCheckpointDir()
    return cur.rstrip("/")


def to_local_path(uri: str) -> str:
    return uri[len("file:"):] if uri.startswith("file:") else uri


def scratch_path(spark: SparkSession, *parts: str) -> str:
    base = shared_dir(spark)
    return "/".join([base, "ledgerline", *parts])


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the Hadoop FileSystem of the path's scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

