"""Snapshot chains, splits of an extract, and typed rows with rejects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources import readers as R
from ledgerline.sources import snapshot as SN
from ledgerline.sources.chain import SnapshotChain
from ledgerline.sources.store import TableStore


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def bucketed(spark, root):
    """Two versions of a bucketed table, a partitioned append and a table that stays."""
    store = TableStore(spark, f"{root}/wh")
    items = spark.range(1000).select("id", (F.col("id") % 3).alias("v"), (2020 + F.col("id") % 2).cast("int").alias("year"))
    one = [store.write_buckets("items", items, 1, "id", 8), store.write_table("still", spark.range(5), 1),
           store.write_table("log", items, 1, partition_by=["year"])]
    store.commit(one, 1)
    return store, items


def test_a_chain_copies_what_is_new_and_expiry_keeps_what_is_shared(spark, tmp_root):
    store, items = bucketed(spark, tmp_root)
    chain = SnapshotChain(spark, f"{tmp_root}/chain")
    assert {r.table_name: (r.row_count, r.copied_rows) for r in chain.export(store, "a").collect()} == {
        "items": (1000, 1000), "still": (5, 5), "log": (1000, 1000)}
    prev = store.manifest()
    touched = [3]
    rows = store.read_buckets(prev["items"], touched).withColumn("v", F.lit(9).cast("long"))
    n = rows.count()
    entries = [store.write_buckets("items", rows, 2, "id", 8, prev["items"], touched), store.write_table("log", items.limit(10), 2, append_to=prev["log"], partition_by=["year"])]
    store.commit(entries, 2, keep=prev)
    assert {r.table_name: (r.row_count, r.copied_rows) for r in chain.export(store, "b").collect()} == {
        "items": (1000, n), "still": (5, 0), "log": (1010, 10)}
    assert {r.copied_rows for r in chain.export(store, "c").collect()} == {0}              # nothing is copied of an unchanged store
    for label, version in (("a", 1), ("b", 2), ("c", 2)):
        back = TableStore(spark, f"{tmp_root}/{label}")
        chain.restore(label, back)
        for t in ("items", "still", "log"):
            assert rows_of(back.read(t)) == rows_of(store.read(t, version).select(*back.read(t).columns)), (label, t)
        assert back.manifest()["items"]["layout"]
    assert chain.expire(keep=1) == 1                                                    # only the bucket that "b" replaced
    assert chain.snapshots() == ["c"]
    chain.restore("c", TableStore(spark, f"{tmp_root}/after"))
    with pytest.raises(SN.SnapshotError, match="not found"):
        chain.restore("a", TableStore(spark, f"{tmp_root}/gone"))
    with pytest.raises(SN.SnapshotError, match="exists"):
        chain.export(store, "c")


def test_a_spoiled_or_missing_part_is_named(spark, tmp_root):
    store, _ = bucketed(spark, tmp_root)
    chain = SnapshotChain(spark, f"{tmp_root}/chain")
    chain.export(store, "a")
    part = chain.manifest("a").where("table_name = 'items' AND part LIKE '%_bucket=5'").first()
    spark.range(3).select("id", F.lit(1).cast("long").alias("v"), F.lit(1).alias("year")).write.mode("overwrite").parquet(part["path"])
    into = TableStore(spark, f"{tmp_root}/r")
    with pytest.raises(SN.SnapshotError, match="items does not verify: .*_bucket=5$"):
        chain.restore("a", into)
    assert into.current_version() == 0


def test_splits_cover_every_row_once(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(7)).otherwise(
        F.pow(F.col("id"), 2).cast("long")).alias("k"))
    points = R.split_points(keys, "k", 10)
    predicates = R.split_predicates("k", points)
    n = [keys.where(p).count() for p in predicates]
    assert sum(n) == 20_000 and len(predicates) == len(points) + 1 < 10                 # the value 7 fills several splits
    even = spark.range(9000).select((F.col("id") * F.col("id")).alias("k"))
    sizes = [even.where(p).count() for p in R.split_predicates("k", R.split_points(even, "k", 9))]
    assert len(sizes) == 9 and all(abs(s - 1000) <= 100 for s in sizes)
    dates = spark.range(100).select(F.date_add(F.lit("2030-01-01"), F.col("id").cast("int")).alias("k"))
    assert sum(dates.where(p).count() for p in R.split_predicates("k", R.split_points(dates, "k", 4))) == 100
    empty = R.split_predicates("k", R.split_points(even.limit(0), "k", 4))
    assert empty == ["1 = 1"] and even.where(empty[0]).count() == 9000


def test_rejects_carry_the_raw_row_and_every_reason(spark, tmp_root):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("m", T.DecimalType(5, 2), False),
                           T.StructField("s", T.StringType())])
    raw = spark.createDataFrame([("1", "2030-01-31", "12.345", "ok"), ("x", "2030-02-30", None, "toolong"), ("2", None, "99999", None), (None, None, "1", None)],
                                "id string, day string, m string, s string")
    good, bad = R.ingest_into(raw, schema, f"{tmp_root}/in", {"s": "none"}, {"s": 4})
    assert [tuple(r) for r in good.collect()] == [(1, dt.date(2030, 1, 31), __import__("decimal").Decimal("12.35"), "ok")]
    assert {tuple(r.reasons) for r in bad.collect()} == {
        ("id: not bigint", "day: not date", "m: missing", "s: longer than 4"), ("m: not decimal(5,2)",), ("id: missing",)}
    assert bad.where("raw LIKE '%2030-02-30%'").count() == 1
    with pytest.raises(R.MissingColumnError, match="s"):
        R.ingest(raw.drop("s"), schema)
