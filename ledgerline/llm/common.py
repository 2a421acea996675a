"""What the operators share: scratch tables in the shared folder, running totals, text defaults."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import scratch_path


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_of(name: str) -> Column:
    """The text column as a string; null is the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of ``materialise`` that no later plan reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        parents = {f.rpartition("/")[0] for f in t.inputFiles()}
        for p in parents:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Exclusive running sums over the whole table in the order of ``order``.

    ``totals`` maps a new long column to the column that it sums.  The rows
    are range-partitioned once and written with their partition's number;
    per-partition totals (one row per partition) are accumulated, and each
    partition adds its start to the sums within it.  Returns the rows, and
    the partition totals.
    """
    part = free_name(df, "part")
    ranged = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(part).agg(*[F.sum(c).cast("long").alias(f"{part}_{k}") for k, c in totals.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, *[F.coalesce(F.sum(f"{part}_{k}").over(before), F.lit(0)).alias(f"{part}_{k}")
                                 for k in totals])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).cast("long").alias(k)
                                for k, c in totals.items()])
    rows = rows.join(starts, part)
    return rows.select(*df.columns, *[(F.col(k) + F.col(f"{part}_{k}")).alias(k) for k in totals]), sums


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, id, text) with ``doc`` unique in the order of the ids, and whether it is the id itself.

    It is where ids are integers, not null and unique; else rows are numbered.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    if slim.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long") and \
            slim.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        return slim.select(F.col("id").cast("long").alias("doc"), "id", "text"), True
    stored = materialise(slim.withColumn("place", F.monotonically_increasing_id()), "texts")
    ranks, _ = running_totals(stored.select("id", "place", F.lit(1).alias("one")), ["id", "place"], {"doc": "one"})
    return materialise(stored.join(ranks.select("place", "doc"), "place").select("doc", "id", "text"), "texts"), False


def summed_vectors(rows: DataFrame, count: Callable[[Iterator], np.ndarray], size: int, parts: int = 256) -> np.ndarray:
    """The sum of the vector of ``size`` counts that ``count`` makes of each partition's Arrow batches.

    A vector travels in ``parts`` rows by range and is added there; ``size`` sums are gathered.
    """
    import pyarrow as pa
    step, kind = size // parts, "part int, counts binary"

    def packed(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()),
                                           pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["part", "counts"])

    def task(batches):
        total = count(batches).astype(np.int64)
        if total.any():
            yield packed({p: total[p * step:(p + 1) * step] for p in range(parts)})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[p] = totals.get(p, 0) + np.frombuffer(x, np.int64)
        if totals:
            yield packed(totals)
    out = np.zeros((parts, step), np.int64)
    for row in rows.mapInArrow(task, kind).repartition("part").mapInArrow(add, kind).collect():     # ``parts`` rows
        out[row["part"]] += np.frombuffer(row["counts"], np.int64)
    return out.ravel()
