"""Digests by key range: what differs is found, named, and nothing else is read."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes as CH
from ledgerline.operators import digests as D
from ledgerline.sources import ranged as RG
from ledgerline.sources import snapshot as SN
from ledgerline.sources import testdata
from ledgerline.sources.store import TableStore

from conftest import SF_SMALL

COLS = ["customer_id", "amount", "status"]


def table(spark, n):
    return spark.range(-500, n).select(F.col("id").alias("loan_id"), (F.col("id") % 7).alias("customer_id"), (F.col("id") * 2).alias("amount"),
                                       F.lit("active").alias("status"))


def test_one_changed_row_reads_one_range(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    old = table(spark, 5000)
    new = old.withColumn("status", F.when(F.col("loan_id") == 3210, "repaid").otherwise(F.col("status")))
    for v in (old, new):
        RG.write(store, {"loans": (v, "loan_id")}, 10)
    a, b, keys = RG.changed_part(store, "loans", 1, 2)
    assert keys == [(3210, 3219)] and a.count() == b.count() == 10
    files = {f.rpartition("/")[0].rpartition("=")[2] for x in (a, b) for f in x.inputFiles()}
    assert files == {str(321 // D.FAN)}                                    # one directory of each version
    assert [(r.operation, r.record_id, r.changed_columns) for r in RG.diff(store, "loans", 1, 2).collect()] == [("UPDATE", 3210, "status")]


def test_any_changes_equal_the_plain_diff(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    old = table(spark, 3000).where("loan_id % 11 != 0")
    new = (old.where("loan_id % 97 != 5").withColumn("amount", F.when(F.col("loan_id") % 301 == 9, -1).otherwise(F.col("amount")))
           .unionByName(table(spark, 3100).where("loan_id >= 3000 OR loan_id % 440 = 0")))
    nulls = spark.createDataFrame([(None, 1, 1, "x")], "loan_id long, customer_id long, amount long, status string")
    for v in (old, new.unionByName(nulls)):
        RG.write(store, {"loans": (v, "loan_id")}, 4)
    want = CH.diff(old, new.unionByName(nulls), "loan_id")
    got = RG.diff(store, "loans", 1, 2)
    assert got.count() == want.count() > 50 and got.exceptAll(want).isEmpty()
    assert RG.diff(store, "loans", 2, 2).isEmpty() and RG.faulty(store, "loans") == []


def test_ranges_join_near_leaves_and_lose_none(spark):
    leaves = spark.createDataFrame([(x,) for x in (-3, 1, 2, 3, 50, 51, 900, 1000)], "leaf long")
    assert D.ranges(leaves, 10, 100) == [(-30, -21), (10, 39), (500, 519), (9000, 9009), (10000, 10009)]
    assert D.ranges(leaves, 10, 2) == [(-30, 519), (9000, 10009)]
    assert D.ranges(leaves.limit(0), 10) == []


def test_restore_names_the_faulty_range(spark, tmp_root):
    src = testdata.source_tables(spark, SF_SMALL)
    SN.export(spark, src, f"{tmp_root}/s", "a", "operational")
    assert all(r.checksum_match for r in SN.restore(spark, f"{tmp_root}/s", "a", TableStore(spark, f"{tmp_root}/ok")).collect())
    path = f"{tmp_root}/s/a/loans"
    loans = spark.read.parquet(path)
    victim = loans.agg(F.min("loan_id")).first()[0]
    spoiled = spark.createDataFrame(loans.withColumn("branch_code", F.when(F.col("loan_id") == victim, "BR-X").otherwise(
        F.col("branch_code"))).toPandas(), loans.schema)
    spoiled.write.mode("overwrite").parquet(path)
    store = TableStore(spark, f"{tmp_root}/r")
    with pytest.raises(SN.SnapshotError, match=rf"loans: loan_id {victim // 1}\.\.") as e:
        SN.restore(spark, f"{tmp_root}/s", "a", store)
    assert "payments: " not in str(e.value) and store.current_version() == 0
