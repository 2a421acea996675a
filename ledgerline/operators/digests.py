"""Two-level digests of a table by ranges of its integer key.

A leaf is a range of ``width`` keys with its rows and the sum of their hashes; a
top is ``FAN`` leaves.  Two versions are compared top by top, and leaf by leaf
only below tops that differ; what differs is named as key ranges.  Digests
do not depend on the order of rows, and add up: a table's checksum is the sum of its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of a top; most leaves that ``width_for`` gives a table, so that their numbers fit the driver.
FAN, MOST_LEAVES = 64, 65_536
PRIME = 2 ** 61 - 1


def width_for(df: DataFrame, key: str, leaves: int = MOST_LEAVES) -> int:
    """Keys of a leaf such that the table's keys span at most about ``leaves`` leaves."""
    span = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return max(1, -(-(span["b"] - span["a"] + 1) // leaves)) if span["a"] is not None else 1


def leaf_of(key: str | Column, width: int) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.floor(c / F.lit(width)).cast("long") if width > 1 else c.cast("long")


def top_of(leaf: str = "leaf") -> Column:
    return F.floor(F.col(leaf) / F.lit(FAN)).cast("long")


def leaf_digests(df: DataFrame, key: str, width: int) -> DataFrame:
    """(leaf, rows, digest) of each leaf that holds rows; rows without key are the leaf null.  Combined before the shuffle."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.groupBy(leaf_of(key, width).alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), F.pmod(F.sum(h), F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias("digest"))


def tops(leaves: DataFrame) -> DataFrame:
    """(top, rows, digest): the leaves added up."""
    return leaves.groupBy(top_of().alias("top")).agg(
        F.sum("rows").alias("rows"), F.pmod(F.sum(F.col("digest").cast("decimal(38,0)")), F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias("digest"))


def _differs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows or digest differ, also where one side lacks them."""
    both = a.select(key, F.lit(0).alias("side"), "rows", "digest").unionByName(b.select(key, F.lit(1).alias("side"), "rows", "digest"))
    seen = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rows", "digest")).alias("x"), F.max(F.struct("rows", "digest")).alias("y"))
    return seen.where((F.col("n") < 2) | (F.col("x") != F.col("y"))).select(key)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The leaves that differ; leaves are compared only below tops that do (the leaf null: rows without key)."""
    top = _differs(tops(a), tops(b), "top").withColumnRenamed("top", "_top")
    below = [x.join(top, top_of().eqNullSafe(F.col("_top")), "left_semi") for x in (a, b)]
    return _differs(*below, "leaf")


def ranges(leaves: DataFrame, width: int, most: int = 64) -> list[tuple[int, int]]:
    """The leaves as at most ``most`` ranges of keys (first, last), near ones joined: at most MOST_LEAVES numbers are gathered.

    Joining covers some leaves that do not differ; it loses none.
    """
    at = sorted(r[0] for r in leaves.where("leaf IS NOT NULL").collect())
    if not at:
        return []
    gaps = sorted(range(1, len(at)), key=lambda i: at[i - 1] - at[i])                       # the widest gaps first
    cuts = sorted(i for i in gaps[:most - 1] if at[i] - at[i - 1] > 1)
    starts, ends = [0, *cuts], [*cuts, len(at)]
    return [(at[a] * width, (at[b - 1] + 1) * width - 1) for a, b in zip(starts, ends, strict=True)]


def within(key: str, keys: list[tuple[int, int]], nulls: bool = False) -> Column:
    """Whether the key lies in one of the ranges: comparisons that reach the scan."""
    out = F.col(key).isNull() if nulls else F.lit(False)
    for a, b in keys:
        out = out | F.col(key).between(a, b)
    return out
