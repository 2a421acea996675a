"""Dense surrogate keys without a single-partition window.

New natural keys are range-partitioned and sorted inside each partition;
the partition layout is frozen in a compressed scratch table (range sampling
could differ on recompute), then each row's key is

    start + (rows in earlier partitions) + (position inside its partition) + 1

The offsets table has one row per partition, so the only global step
runs over a frame bounded by the partition count, never by the data.
"""

from __future__ import annotations

import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path

#: The layouts made in a block of ``layouts``, by surrogate key.
_LAYOUTS: ContextVar[dict[str, list[str]] | None] = ContextVar("layouts", default=None)


@contextlib.contextmanager
def layouts(spark: SparkSession):
    """Gives a function that removes the layouts of a surrogate key, for a writer that has stored its rows; the end of
    the block removes the others.  Without such a block layouts stay, as their rows may be read at any time."""
    held: dict[str, list[str]] = {}

    def written(sk_col: str | None) -> None:
        for path in held.pop(sk_col, []):
            remove_path(spark, path)
    token = _LAYOUTS.set(held)
    try:
        yield written
    finally:
        _LAYOUTS.reset(token)
        for sk_col in list(held):
            written(sk_col)


def assign_dense_keys(df: DataFrame, key_cols: list[str], sk_col: str,
                      start: int | Column = 0, num_partitions: int | None = None) -> DataFrame:
    """Append ``sk_col`` = ``start`` + dense 1-based rank of ``key_cols``.

    ``df`` must hold each natural key once (callers de-duplicate or fail
    fast on duplicates before assigning keys).
    """
    # Without an explicit count AQE sizes the range partitions from runtime
    # statistics (merged partitions stay contiguous key ranges).
    ranged = (df.repartitionByRange(num_partitions, *key_cols) if num_partitions
              else df.repartitionByRange(*key_cols))
    # the id holds the partition and, in its lower 33 bits, the position; a void column has nothing to store
    void = [f.name for f in df.schema.fields if f.dataType.typeName() == "void"]
    path = scratch_path(df.sparkSession, "keys", f"{sk_col}-{uuid.uuid4().hex}")
    if (held := _LAYOUTS.get()) is not None:
        held.setdefault(sk_col, []).append(path)
    laid = ranged.sortWithinPartitions(*key_cols).withColumn("_km", F.monotonically_increasing_id()).drop(*void)
    laid.write.option("compression", "zstd").parquet(path)
    tagged = df.sparkSession.read.schema(laid.schema).parquet(path).withColumns({c: F.lit(None) for c in void})
    tagged = tagged.select(*df.columns, "_km", F.shiftright("_km", 33).cast("int").alias("_kp"))
    # only the ids are read here
    counts = tagged.groupBy("_kp").agg(F.count(F.lit(1)).alias("_kn"), F.min("_km").alias("_kf"))
    before = Window.orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_kp", "_kf", F.coalesce(F.sum("_kn").over(before), F.lit(0)).alias("_ko"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    # offsets has one row per partition: broadcasting it is bounded by n.
    return (
        tagged.join(F.broadcast(offsets), "_kp")
        .withColumn(sk_col, (start_col + F.col("_ko") + (F.col("_km") - F.col("_kf")) + 1).cast("long"))
        .drop("_kp", "_km", "_kf", "_ko")
    )


def next_key_start(existing: DataFrame | None, sk_col: str) -> int:
    """Largest key in use (0 for an empty / missing table)."""
    if existing is None:
        return 0
    v = existing.agg(F.max(sk_col)).first()[0]
    return int(v or 0)
