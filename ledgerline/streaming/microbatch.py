"""Micro-batch loading with Structured Streaming.

New source files land in a folder; ``readStream`` (explicit schema, no
inference) picks them up and ``foreachBatch`` runs the same keyed load
as the batch path, so every micro-batch is idempotent by key:

* payments: each batch runs the load in increment mode - new rows are
  appended to the accumulated source (insert-if-absent by
  ``payment_id``), per-loan totals are folded in, and only the batch plus
  still-pending payments are staged; a replayed batch inserts nothing;
* the feed: changed customers, loans and payments in one stream of tagged rows;
  each batch runs the load of changes, whose cost follows the batch;
* changes: each batch of change rows is folded into the state table, which
  keeps each key's log id and delete marker; only a greater log id counts.

No batch is skipped by its number: numbers start again with each checkpoint,
and the keys alone say what is new.  The batch id goes into the run log.
Production uses ``trigger(processingTime='15 minutes')``; tests use
``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import fold_changes, latest_per_key, live_state
from ..operators.runlog import RunLog
from ..plans.delta import load_changes
from ..plans.warehouse import load
from ..session import shuffles_released, small_splits
from ..sources import schemas as S
from ..sources.store import TableStore

Sources = dict[str, DataFrame]


def _started(spark: SparkSession, landing: str, schema, run_batch, checkpoint: str, trigger: dict | None,
             files_per_trigger: int | None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    w = reader.parquet(landing).writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    with small_splits(spark), shuffles_released(spark):      # the stream runs in a copy of the session, taken at its start
        return w.trigger(**(trigger or {"availableNow": True})).start()


def payment_stream(spark: SparkSession, landing: str, schema, warehouse: TableStore,
                   parents: Sources | Callable[[], Sources], checkpoint: str,
                   run_ts_of: Callable[[int], str | None] = lambda b: None,
                   trigger: dict | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the payment micro-batch load (L1-L3).

    ``parents``: the tables besides payments, or a function that reads them
    anew for each batch, so that loans and customers that come after the
    start are seen.  ``files_per_trigger``: None takes all files that are there.
    """
    log = RunLog(spark, warehouse.root)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        src = parents() if callable(parents) else parents
        load(spark, warehouse, {**src, "payments": df}, run_ts_of(batch_id), batch_id=batch_id,
             log=log, increment=True)
    return _started(spark, landing, schema, run_batch, checkpoint, trigger, files_per_trigger)


#: What a row of the feed may be of, and its key.
FEED = {"customers": ("customer_id", S.CUSTOMERS), "loans": ("loan_id", S.LOANS), "payments": ("payment_id", S.PAYMENTS)}
FEED_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("of", T.StringType()), T.StructField("deleted", T.BooleanType()),
                            *[T.StructField(t, s) for t, (_, s) in FEED.items()]])


def feed(spark: SparkSession, seq: int, **changed: DataFrame) -> DataFrame:
    """Changed rows of several tables as one: the row stands in the column named like its table."""
    out = spark.createDataFrame([], FEED_SCHEMA)
    for t, df in changed.items():
        row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in FEED[t][1].fields])
        out = out.unionByName(df.select(F.lit(seq).cast("long").alias("seq"), F.lit(t).alias("of"), F.lit(False).alias("deleted"), row.alias(t)),
                              allowMissingColumns=True)
    return out


def of_feed(batch: DataFrame) -> Sources:
    """The changed rows of each table that a batch of the feed holds; of a row's states the one of the greatest ``seq``.

    Payments are insert-only: all their rows are kept, so that rows of one id that differ are seen.
    """
    out = {}
    held = [r["of"] for r in batch.select("of").distinct().collect()]                       # table names
    for t, (key, _) in FEED.items():
        if t in held:
            rows = batch.where((F.col("of") == t) & F.col(f"{t}.{key}").isNotNull()).select("seq", F.col("deleted").alias("_deleted"), f"{t}.*")
            out[t] = rows.where("NOT coalesce(_deleted, false)").drop("seq", "_deleted") if t == "payments" else latest_per_key(rows, key, "seq").drop("seq")
    return out


def feed_stream(spark: SparkSession, landing: str, warehouse: TableStore, products: DataFrame, checkpoint: str,
                run_ts_of: Callable[[int], str | None] = lambda b: None, trigger: dict | None = None,
                files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the micro-batch load of a feed: each batch costs the buckets that its rows touch (L1-L3)."""
    log = RunLog(spark, warehouse.root)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        load_changes(spark, warehouse, {**of_feed(df), "loan_products": products}, run_ts_of(batch_id), batch_id, log)
    return _started(spark, landing, FEED_SCHEMA, run_batch, checkpoint, trigger, files_per_trigger)


def change_stream(spark: SparkSession, landing: str, schema, state: TableStore, key: str,
                  attrs: list[str], to_log: Callable[[DataFrame], DataFrame], checkpoint: str,
                  trigger: dict | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """Continuously fold change rows into a state table (L4); ``read_state`` gives the live rows."""

    def run_batch(df: DataFrame, batch_id: int) -> None:
        prev = state.manifest()
        version = state.current_version() + 1
        e = state.write_table("state", fold_changes(state.read("state") if prev else None, to_log(df), key, attrs), version)
        state.commit([e], version, keep=prev)
    return _started(spark, landing, schema, run_batch, checkpoint, trigger, files_per_trigger)


def read_state(state: TableStore) -> DataFrame:
    return live_state(state.read("state"))


def land(df: DataFrame, landing: str, name: str) -> None:
    """Land source rows (what an upstream extract would drop), in as many files as ``df`` has partitions; zstd, like the tables."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{landing}/{name}")
