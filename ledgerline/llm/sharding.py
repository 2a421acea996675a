"""Sharding by global prefix sums of byte sizes: contiguous shards of nearly equal size.

Documents stand in the order of their id.  Per-partition totals give each
partition the bytes before it, and a document goes to the shard in whose
equal share of all bytes its middle lies.  Only slim rows travel; no shard is
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, running_totals, text_of


def size_of(text_col: str):
    """UTF-8 bytes of the text plus 1; a null text has none."""
    return (F.octet_length(text_of(text_col)) + 1).cast("long")


def assign_shards(rows: DataFrame, shards: int, id_col: str = "doc_id", size_col: str = "size",
                  tie_cols: list[str] | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within the shard).

    Order: id (nulls first), then ``tie_cols``, then the place in the input, so
    repeated ids are split over tasks like any others.  A single document
    larger than a share leaves shards empty around it.
    """
    place, one, start, rank = (free_name(rows, n) for n in ("place", "one", "start", "rank"))
    rows = rows.withColumn(place, F.monotonically_increasing_id()).withColumn(one, F.lit(1))
    out, sums = running_totals(rows, [id_col, *(tie_cols or []), place], {start: size_col, rank: one})
    whole = sums.agg(F.coalesce(F.sum(sums.columns[1]), F.lit(0)).alias("bytes")).first()["bytes"]   # one row
    middle = (F.col(start) + F.col(size_col) / 2) * shards / F.lit(max(whole, 1))
    out = materialise(out.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int")), "shards")
    first = out.groupBy("shard").agg(F.min(rank).alias("first_rank"))                 # one row per shard
    return (out.join(F.broadcast(first), "shard").withColumn("slot", F.col(rank) - F.col("first_rank"))
            .drop(place, one, start, rank, "first_rank"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text",
                 writers: int = 16) -> None:
    """Write every column of ``docs`` into ``path/shard=k``; each shard by up to ``writers`` tasks, in slot order within each.

    Shards need ids that are unique; repeated ids raise no error, their rows share the smallest shard of the id.
    """
    size, to_id = free_name(docs, "size"), free_name(docs, "to_id")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), size_of(text_col).alias(size))
    to = (assign_shards(slim, shards, "id", size).groupBy(F.col("id").alias(to_id))
          .agg(F.min("shard").alias("shard"), F.min("slot").alias("slot")))
    out = docs.drop("shard", "slot").join(to, F.col(f"`{id_col}`").eqNullSafe(F.col(to_id))).drop(to_id)
    (out.repartition(shards * writers, "shard", F.pmod(F.floor(F.col("slot") / 64), F.lit(writers)))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
