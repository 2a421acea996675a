import pytest
from pyspark.sql import functions as F

from ledgerline.operators.keys import assign_dense_keys
from ledgerline.operators.upsert import DuplicateKeyError, assert_unique_keys, insert_absent, scd2, upsert


def test_dense_keys_follow_key_order_across_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    out = assign_dense_keys(df, ["k"], "sk", start=100, num_partitions=5).collect()
    assert sorted((r.k, r.sk) for r in out) == [(k, 101 + k) for k in range(1000)]


def test_upsert_updates_listed_columns_only_and_null_overwrites(spark):
    cur = spark.createDataFrame([(10, 1, "a", "x"), (20, 2, "b", "y")], "sk long, id int, s string, f string")
    staged = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "id int, s string, f string")
    out = {r.id: r for r in upsert(cur.select("id", "s", "f", "sk"), staged, "id", ["s"], sk_col="sk",
                                   columns=["id", "s", "f"]).collect()}
    assert out[1].s == "a" and out[1]._op == "keep"
    assert out[2].s is None and out[2].f == "y" and out[2]._op == "update"   # NULL overwrites, f frozen
    assert out[3].sk == 21 and out[3]._op == "insert"                         # after max key


def test_insert_absent_is_idempotent(spark):
    staged = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    t1, new1 = insert_absent(None, staged, "id", sk_col="sk")
    t2, new2 = insert_absent(t1, staged, "id", sk_col="sk")
    assert new1.count() == 2 and new2.count() == 0 and t2.count() == 2


def test_duplicate_key_fails_fast(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "id int")
    with pytest.raises(DuplicateKeyError):
        assert_unique_keys(df, "id")
    assert_unique_keys(df.where("id is null"), "id")   # NULL keys are not duplicates


def test_scd2_closes_changed_rows_and_opens_versions(spark):
    s1 = spark.createDataFrame([(1, "retail"), (2, "sme")], "id int, seg string")
    s2 = spark.createDataFrame([(1, "corporate"), (2, "sme"), (3, "retail")], "id int, seg string")
    v1 = scd2(None, s1, "id", ["seg"], "sk", F.lit("2030-01-01"))
    v2 = scd2(v1, s2, "id", ["seg"], "sk", F.lit("2030-01-02"))
    rows = sorted((r.sk, r.id, r.seg, r.is_current, str(r.expiry_date)) for r in v2.collect())
    assert rows == [(1, 1, "retail", False, "2030-01-01"), (2, 2, "sme", True, "None"),
                    (3, 1, "corporate", True, "None"), (4, 3, "retail", True, "None")]
