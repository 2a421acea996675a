import random

import numpy as np
from pyspark.sql import functions as F
from ledgerline.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("b.net", "/x", "block"), ("net", "/", "block")]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_judging_against_plain_version(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://com?x", "https://www.Example.com/en/a?b#c",
            "x://a.example.com/en", "http://example.com/en/", "http://xexample.com/en/", "http://é.net/", "http://İ.net/", "a://b://c.net/",
            "http://b.net/x/" + "y" * 10_000, "http://" + "a." * 200 + "com/", "http://.com/", "http://com./"]
    for _ in range(300):
        host = ".".join(rng.choice(["www", "example", "com", "net", "b", "N"]) for _ in range(rng.randint(1, 4)))
        urls.append(f"http://{host}{rng.choice(['', '/', '/en/', '/en', '/x', '/xy?q', '#f'])}")
    pages = spark.createDataFrame([(i, u, "r", "k") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string, keys string")
    out = U.judge(pages.repartition(4), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"]
    assert [tuple(r)[3:] for r in sorted(out.collect(), key=lambda r: r.page_id)] == [plain(u, RULES) for u in urls * 2]


def test_cascade_is_exact_over_the_universe(spark):
    listed = [f"listed{i}.com/" for i in range(700)]
    other = [f"other{i}.com/" for i in range(30_000)]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    levels = U.build(frame([*listed, listed[0], None]), frame(listed[:300] + other + other[:50]))
    assert len(levels) > 2
    for keys, want in ((listed, True), (other, False)):
        h = frame(keys).select(*U.hashes(F.col("key"))).toPandas().to_numpy()
        assert (U.is_listed(levels, h[:, 0], h[:, 1]) == want).all()
    bits = sum(x.bits for x in levels)
    assert bits < 700 * (1.5 * np.log2(30_000 / 700) + 12)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(one, rules.limit(0)).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]


def test_rules_in_parts_judge_like_one_cascade(spark, monkeypatch):
    rng = random.Random(2)
    labels = ["a", "b", "c", "www", "net", "com"]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(["/", "/x", "/x/y"])): rng.choice(["allow", "block", "ask"]) for _ in range(60)}
    rules = [(*k, v) for k, v in rules.items()]
    urls = [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/x/y/z'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = [plain(u, rules) for u in urls]
    for parts in (1, 3):
        monkeypatch.setattr(U, "cascade_parts", lambda *a, parts=parts: parts)
        got = sorted(U.judge(pages, frame).collect(), key=lambda r: r.page_id)
        assert [tuple(r)[2:] for r in got] == want


def test_parts_follow_the_size_of_the_cascades():
    assert U.cascade_parts(5, 10 ** 12) == 1 and U.cascade_parts(10 ** 6, 10 ** 10) == 1
    assert U.cascade_parts(10 ** 9, 10 ** 12) > 5


def test_a_level_that_is_gathered_in_pieces_holds_its_keys(spark, monkeypatch):
    monkeypatch.setattr(U, "FETCH_WORDS", 4000)
    keys = spark.range(60_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    level = U.Level.sized(0, 60_000, 0.001).fill(keys.repartition(5))
    assert len(level.words) > 3 * U.FETCH_WORDS
    h = keys.toPandas().to_numpy()
    assert level.has(h[:, 0], h[:, 1]).all()
    other = spark.range(60_000, 90_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2")).toPandas().to_numpy()
    assert level.has(other[:, 0], other[:, 1]).mean() < 0.004
