import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions.exprs import epoch_seconds, utc_from_offset_text
from ledgerline.operators.upsert import delete_keys, update_where
from ledgerline.sources import schemas as S
from ledgerline.sources.readers import apply_defaults, custom_schema, jdbc_options


def test_offset_timestamp_normalised_to_utc(spark):
    df = spark.createDataFrame([("2024-01-15 01:00:00+03",)], "t string")
    r = df.select(utc_from_offset_text("t").alias("ts")).select("ts", F.to_date("ts").alias("d")).first()
    assert r.ts == dt.datetime(2024, 1, 14, 22, 0, 0) and r.d == dt.date(2024, 1, 14)
    assert df.select(epoch_seconds(utc_from_offset_text("t"))).first()[0] == 1705269600


def test_defaults_and_keyed_update_delete(spark):
    df = spark.createDataFrame([(1, None, None), (2, "Nairobi", "sme")], "id int, country string, segment string")
    out = {r.id: (r.country, r.segment) for r in apply_defaults(df, S.CUSTOMER_DEFAULTS).collect()}
    assert out == {1: ("Kenya", "retail"), 2: ("Nairobi", "sme")}
    up = update_where(df, F.col("id") == 2, {"segment": F.lit("corporate")})
    assert {r.id: r.segment for r in up.collect()} == {1: None, 2: "corporate"}
    assert [r.id for r in delete_keys(df, spark.createDataFrame([(1,)], "id int"), "id").collect()] == [2]


def test_jdbc_options_from_conf(spark):
    spark.conf.set("spark.ledgerline.source.url", "jdbc:sourcedb://host:5432/db")
    spark.conf.set("spark.ledgerline.source.user", "reader")
    opts = jdbc_options(spark)
    assert opts["url"].startswith("jdbc:sourcedb") and opts["user"] == "reader"
    assert "amount DECIMAL(14,2)" in custom_schema(S.LOANS)
