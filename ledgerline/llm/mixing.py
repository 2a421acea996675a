"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n of N documents and target share w gets the rate w * N / n,
the mean count of each of its documents.  A hash of seed and document id is a
uniform number; the smallest k whose Poisson distribution function reaches it
is the count.  Each document is exploded by its count, and the copies are
shuffled over the whole output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rates above this are drawn as a sum of equal parts, each with its own hash.
PART_RATE = 32.0


def source_rates(docs: DataFrame, source_col: str, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, docs, rate, parts, steps): one row per source.

    ``weights``: target shares, in any unit; sources without one get 0.
    Without ``weights`` a source's share follows the square root of its size,
    in thousandths, which lifts small sources.  ``steps`` is the Poisson
    distribution function of rate/parts from 0 up to where it stays below 1.
    A null source is a source of its own.
    """
    n = docs.groupBy(F.col(f"`{source_col}`").alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.round(F.sqrt("n") * 1000).cast("double")
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    n = n.withColumn("weight", weight)
    whole = n.agg(F.sum("n").cast("double").alias("n"), F.sum("weight").alias("weight")).first()   # one row
    rate = F.lit(whole["n"]) * F.col("weight") / (F.lit(whole["weight"]) * F.col("n"))
    rates = n.withColumn("rate", rate if whole["weight"] else F.lit(0.0))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    lam = F.col("rate") / F.col("parts")
    zero = F.exp(-lam)
    steps = F.aggregate(
        F.sequence(F.lit(1), F.ceil(lam + 12 * F.sqrt(lam) + 20).cast("int")),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("cdf")),
        lambda a, k: F.struct((a["p"] * lam / k).alias("p"), (a["c"] + a["p"] * lam / k).alias("c"),
                              F.concat(a["cdf"], F.array(a["c"] + a["p"] * lam / k)).alias("cdf")),
        lambda a: a["cdf"])
    return rates.select("mix_source", "n", "rate", "parts", steps.alias("steps"))


def uniform(seed: int, key: Column, part: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")),
                               part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def replicated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               weights: dict[str | None, float] | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with ``copies`` and ``copy`` (from 0): each row as often as drawn, in input order.

    Rows that repeat an id draw the same count.  Columns of ``docs`` keep
    their names; ``copy`` and ``copies`` replace columns of these names.
    """
    docs = docs.drop("copies", "copy")
    source, parts, steps = (free_name(docs, c) for c in ("mix_source", "parts", "steps"))
    rates = source_rates(docs, source_col, weights).select(
        F.col("mix_source").alias(source), F.col("parts").alias(parts), F.col("steps").alias(steps))
    counted = docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    numbers = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(seed, F.col(f"`{id_col}`"), j))
    copies = F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter(F.col(steps), lambda c: c <= u)))
    counted = counted.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("copies")).filter("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        weights: dict[str | None, float] | None = None, seed: int = 7) -> DataFrame:
    """``replicated`` in a random order over the whole output (one shuffle of what stays)."""
    out = replicated(docs, id_col, source_col, weights, seed)
    key = free_name(out, "mix_key")
    place = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), "copy", F.monotonically_increasing_id())
    return out.withColumn(key, place).repartition(F.col(key)).sortWithinPartitions(key).drop(key)
