"""What large tables met: keys beyond a long's cube, and steps that moved whole rows to look at their keys."""

import shutil

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from ledgerline.operators import upsert as UP
from ledgerline.operators.keys import assign_dense_keys
from ledgerline.session import LOAD_SPLIT, small_splits


def test_split_keys_of_large_ids_do_not_overflow(spark, tmp_root):
    for t in ("customer", "nation", "region", "orders"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{tmp_root}/{t}.parquet")
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    rows.withColumn("l_orderkey", F.col("l_orderkey") * 100_000).write.parquet(f"{tmp_root}/lineitem.parquet")
    got = E.queries()["extract_splits"](spark, tmp_root).collect()
    n = rows.count()
    assert [tuple(r) for r in got] == [(8, n, n, True)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_keys_of_their_own_are_not_moved(spark):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert "Exchange" not in _plan(UP.one_per_key(rows, "id")) and "Exchange" not in _plan(UP.with_dup_count(rows, "id"))
    assert {tuple(r) for r in UP.one_per_key(rows, "id").collect()} == {(i, str(i), 0) for i in range(100)}


def test_rows_of_keys_that_repeat_are_compared(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "d"), (3, "c"), (None, "n"), (None, "n"), (4, None)], "id long, s string")
    want = {(1, "a", 0), (2, "b", 0), (3, "c", 1), (None, "n", 0), (4, None, 0)}
    for most in (UP.MOST_REPEATED, 1):                      # the repeated keys broadcast; too many for that
        monkeypatch.setattr(UP, "MOST_REPEATED", most)
        got = [tuple(r) for r in UP.one_per_key(rows, "id").collect()]
        assert len(got) == 5 and set(got) == want
    assert sorted(r["_dup"] for r in UP.with_dup_count(rows, "id").collect()) == [1, 1, 2, 2, 2, 2, 2, 2]


def test_dense_keys_freeze_their_layout_in_a_table(spark):
    rows = spark.range(50).select((49 - F.col("id")).alias("k"), F.lit(None).alias("nothing"))
    out = assign_dense_keys(rows, ["k"], "sk", 7, 4)
    assert "ExistingRDD" not in _plan(out) and out.columns == ["k", "nothing", "sk"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, None, i + 8) for i in range(50)]


def test_loads_read_small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    own = spark.conf.get(name)
    try:
        for held, inside in (("128MB", str(LOAD_SPLIT)), ("134217728b", str(LOAD_SPLIT)), ("1g", str(LOAD_SPLIT)), ("16m", "16m"), ("1000", "1000")):
            spark.conf.set(name, held)
            with small_splits(spark):
                assert spark.conf.get(name) == inside
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, own)


def test_rows_of_known_keys_are_not_moved_to_find_the_new_ones(spark, monkeypatch):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, s string")
    staged = spark.createDataFrame([(1, "x"), (3, "c"), (3, "d"), (None, "m"), (2, "y")], "id long, s string")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (UP.MOST_REPEATED, 1, -10):             # few new keys; too many; surely too many
            monkeypatch.setattr(UP, "MOST_REPEATED", most)
            assert {tuple(r) for r in UP._unknown(old, staged, "id").collect()} == {(3, "c"), (3, "d"), (None, "m")}
        monkeypatch.undo()
        known = staged.where("id IN (1, 2)")
        none = UP._unknown(old, known, "id")
        assert none.isEmpty() and none.columns == ["id", "s"] and "Exchange" not in _plan(none)
        # the staged side of the semi join, printed before the broadcast side, is not shuffled
        assert "Exchange" not in _plan(UP._unknown(old, staged, "id")).split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
