import base64
import hashlib

from ledgerline.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, refers_to string"
TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def rows_of():
    html = ["", None, "plain", "plain", "é" * 50, TRAP, TRAP + "tail", "x" + TRAP * 3, "\r\n\r\n", "WARC/1.1\r\n", "WARC/1.1\r\n\r\n",
            "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "y" * 200_000, "plain", TRAP, "a\r\n\r\nWARC/1.1\r\n"]
    return [(100 - i, None if i == 3 else f"http://x/{i}\r\nWARC-Type: fake", h, "f", "r") for i, h in enumerate(html * 3)] + [(None, "u", "plain", "f", "r")]


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        again = i is not None and i > first[h or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(map(str, out))


def back(spark, path):
    from pyspark.sql import functions as F
    own = F.col("record_type") == "response"
    page = lambda c: F.regexp_extract(c, r"<urn:page:(.*)>", 1).try_cast("long")
    return W.read(spark, path).select(
        page("record_id").alias("i"), "payload_bytes",
        F.when(own, W.base32_sha1(F.col("payload"))).otherwise(F.substring("digest", 6, 32)).alias("d"), "record_type",
        page("refers_to").alias("r"), "payload")


def test_round_trip_with_magic_inside_payloads(spark, tmp_root):
    rows = rows_of()
    W.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_root}/a")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (was, "700", "64"):                                    # ranges that cut records, headers and magics
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = back(spark, f"{tmp_root}/a").collect()
            assert sorted(str(tuple(r)[:5]) for r in got) == expected(rows)
            if size == "64":
                break
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    bodies = {(h or "").encode() for _, _, h, *_ in rows}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == bodies


def test_least_bytes_and_empty(spark, tmp_root):
    rows = [(2, "u", "ab", "f", "r"), (1, "u", "ab", "f", "r"), (4, "u", "abc", "f", "r"), (3, "u", "abc", "f", "r")]
    W.write(spark.createDataFrame(rows, SCHEMA), f"{tmp_root}/b", least=3)
    assert sorted((r.i, r.record_type) for r in back(spark, f"{tmp_root}/b").collect()) == [
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    W.write(spark.createDataFrame([], SCHEMA), f"{tmp_root}/c")
    assert back(spark, f"{tmp_root}/c").count() == 0


def test_damaged_record_ends_its_file(spark, tmp_root):
    import os
    os.mkdir(f"{tmp_root}/d")
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    with open(f"{tmp_root}/d/one.warc", "w", newline="") as f:
        f.write(good + good.replace("page:1", "page:2").replace("Length: 2", "Length: 7") + good)
    assert [r.i for r in back(spark, f"{tmp_root}/d").collect()] == [1]


def test_rows_that_share_an_id_but_not_the_payload(spark, tmp_root):
    rows = [(5, "u", "A", "f", "r"), (7, "u", "A", "f", "r"), (7, "u", "B", "f", "r"),         # B is in no other page
            (6, "u", "C", "f", "r"), (8, "u", "C", "f", "r"), (8, "u", "A", "f", "r"), (8, "u", "A", "f", "r"),    # two repeated payloads
            (None, "u", "A", "f", "r")]
    W.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_root}/e")
    got = back(spark, f"{tmp_root}/e").collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == expected(rows)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == [b"A", b"A", b"B", b"C"]


def test_byte_ranges_that_change_after_the_chain_is_known(spark, tmp_root):
    rows = rows_of()
    W.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_root}/f")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        table = back(spark, f"{tmp_root}/f")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")                # as if cores came or went between the scans
        assert sorted(str(tuple(r)[:5]) for r in table.collect()) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
