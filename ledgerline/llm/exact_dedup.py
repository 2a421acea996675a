"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame functions only.

Each input partition is a run: its rows reduced to one entry per digest with
the best row and a count.  Rounds follow a binomial tree: in round r the runs
whose numbers differ only in their r-th group of ``bits`` bits meet, up to
``2**bits`` runs a merge.  The entries travel by (merged run, digest), so a
merge is spread over as many tasks as its digests need; the partial
aggregation sorts and combines each run before it travels, and the final one
merges the sorted runs, keeping the best row of each digest and adding the
counts.  The digest is the SHA-256 of the normalised text, so entries that
meet are verified by the full 256 bits at every level.  A hot text is one entry per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, text_of

SPACE = r"[\x20\x09-\x0D]"


def digest_of(text):
    return F.sha2(F.regexp_replace(text, SPACE, ""), 256)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per document: id, digest, code points, its run, and its place (tie-break of repeated rows)."""
    text = text_of(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(digest_of(text)).alias("digest"),
                       F.length(text).alias("chars"), F.spark_partition_id().alias("run"),
                       F.monotonically_increasing_id().alias("place"))


def merge_runs(rows: DataFrame, bits: int = 4) -> DataFrame:
    """(digest, best, n): the best row of each digest over all runs.

    Best: most code points, then smallest id (nulls last), then first place.
    """
    best = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "place")
    last = rows.agg(F.max("run")).first()[0] or 0                       # one row
    runs = rows.select("run", "digest", best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        last >>= bits
        runs = (runs.groupBy(F.shiftright("run", bits).alias("run"), "digest")
                .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        if not last:
            return runs.drop("run")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Nulls and empty texts are one text; of repeated (id, text) rows one is
    kept; an empty table gives an empty result; other columns play no part.
    """
    rows = materialise(digest_rows(docs, id_col, text_col), "digests")
    best = materialise(merge_runs(rows, bits), "merged")
    return rows.join(best, "digest").select(
        "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """``docs`` with one row of each normalised text, all its columns as they were."""
    found = materialise(duplicates(docs, id_col, text_col, bits), "duplicates")
    one, two = free_name(docs, "gone_id"), free_name(docs, "gone_digest")
    gone = (found.groupBy(F.col("id").alias(one), F.col("text_sha256").alias(two))
            .agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    dropped, repeated = gone.filter(~F.col("kept")), gone.filter("kept AND n > 1")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(one)) & (digest_of(text_of(text_col)) == F.col(two))
    out = docs.join(dropped.select(one, two), same, "left_anti")
    if repeated.isEmpty():
        return out
    key = free_name(docs, "digest")
    again = (docs.join(repeated.select(one, two), same, "left_semi")
             .withColumn(key, digest_of(text_of(text_col))).dropDuplicates([id_col, key]).select(*docs.columns))
    return out.join(repeated.select(one, two), same, "left_anti").unionByName(again)
