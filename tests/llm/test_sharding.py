from ledgerline.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, place int, part int"


def test_shards_against_plain_prefix_sums(spark):
    rows = [((i * 37) % 500, None if i % 50 == 0 else "é" * (i * i % 90), "x", 1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    slim = df.select("doc_id", S.size_of("text").alias("size"))
    got = sorted(map(tuple, S.assign_shards(slim, 8).select("doc_id", "size", "shard", "slot").collect()))
    sizes = [(d, len((t or "").encode()) + 1) for d, t, *_ in sorted(rows, key=lambda r: r[0])]
    whole, before, want, slots = sum(s for _, s in sizes), 0, [], {}
    for d, s in sizes:
        shard = min(7, int((before + s / 2) * 8 / whole))
        want.append((d, s, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += s
    assert got == want
    totals = [sum(s for _, s, k, _ in got if k == i) for i in range(8)]
    assert max(totals) - min(totals) <= 2 * max(s for _, s in sizes)


def test_repeats_nulls_and_empty(spark):
    rows = [(None, None, "x", 1, 2), (None, "a", "x", 1, 2)] + [(7, "same", "x", 1, 2)] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.assign_shards(df.drop("shard").withColumn("size", S.size_of("text")), 4).collect()
    assert len(got) == 52
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, size long"), 4).count() == 0


def test_written_shards_hold_every_row(spark, tmp_root):
    rows = [(i, "t" * (i % 13), "x", 1, 2) for i in range(200)]
    S.write_shards(spark.createDataFrame(rows, SCHEMA), 4, f"{tmp_root}/shards", writers=2)
    back = spark.read.parquet(f"{tmp_root}/shards")
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    ids = [sorted(r.doc_id for r in back.filter(f"shard = {k}").collect()) for k in range(4)]
    assert sum(ids, []) == list(range(200))                                    # contiguous


def test_written_shards_of_a_table_with_clashing_columns(spark, tmp_root):
    df = spark.createDataFrame([(i, "t" * i, i, i, i) for i in range(40)], "doc_id long, text string, to_id int, size int, id int")
    S.write_shards(df, 3, f"{tmp_root}/shards", writers=2)
    back = spark.read.parquet(f"{tmp_root}/shards")
    assert sorted((r.doc_id, r.to_id, r.size, r.id) for r in back.collect()) == [(i, i, i, i) for i in range(40)]
