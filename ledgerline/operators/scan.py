"""Skew-safe running sums (distributed prefix scan).

A window ``partitionBy(key).orderBy(...)`` sends every row of a key to
one task, so one key holding a third of the rows would run in a single
task.  Here rows are range-partitioned on (key, order...) instead, which
splits a hot key over many partitions; each partition computes local
running sums per (partition, key), and a small table of per-(partition,
key) totals - at most one row per key per partition it touches - gives
each partition the sum of the key's rows in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str,
                exclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = sum of ``value`` over earlier rows of the same
    key in (order...) order (``exclusive``) or including the row.
    ``order`` must make rows of one key totally ordered."""
    spark = df.sparkSession
    shared_dir(spark)
    # freeze the range layout (sampling may differ on recompute); without an
    # explicit count AQE sizes the partitions (merged ones stay contiguous)
    ranged = (df.repartitionByRange(num_partitions, key, *order) if num_partitions
              else df.repartitionByRange(key, *order))
    tagged = (ranged
              .withColumn("_sp", F.spark_partition_id())
              .checkpoint(eager=True))
    frame_end = -1 if exclusive else 0
    local_w = (Window.partitionBy("_sp", key).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    local = tagged.withColumn("_local", F.coalesce(F.sum(value).over(local_w), F.lit(0)))
    totals = tagged.groupBy("_sp", key).agg(F.sum(value).alias("_tot"))
    before = Window.partitionBy(key).orderBy("_sp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_sp", key, F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_sp", key])
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_sp", "_local", "_off"))
