import math
import random
import zlib
from collections import Counter

import numpy as np
from conftest import SF_SMALL
from ledgerline.llm import quality as Q

SCHEMA = "doc_id long, text string, known_id int, id string, log_weight int"


def corpus():
    rng = random.Random(4)
    words = ["the", "quiet", "river", "and", "stone", "house", "was", "found"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))), 0, "z", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(8, 60))), 0, "z", 1) for i in range(100)]
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows if r[0] % 2] + [(7, None), (None, 1)], "doc_id long, quality int")


def test_good_documents_stay_and_bad_ones_go(spark):
    rows = corpus() + [(2000, None, 0, "z", 1), (2001, "", 0, "z", 1), (None, "the river", 0, "z", 1)] + [(3, corpus()[3][1], 0, "z", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sampler = Q.fit(df, labels_of(spark, corpus()))
    out = Q.sample(df, sampler)
    assert out.schema == df.schema
    ids = [r.doc_id for r in out.collect()]
    assert len([i for i in ids if i is not None and i < 1000]) >= 395
    assert len([i for i in ids if i is not None and 1000 <= i < 2000]) <= 2
    scores = {r.id: r.key for r in Q.scored(df, sampler, "doc_id", "text").collect()}
    assert sorted(k is None or k for k, v in scores.items() if v >= sampler.least) == sorted(k is None or k for k in {*ids})


def test_weights_against_plain_version(spark):
    texts = [r[1] for r in corpus()] + ["é", "abcd", "abcde", ""]
    counts = np.zeros(Q.BUCKETS)
    for t in texts:
        b = t.encode()
        for i in range(len(b) - Q.GRAM + 1):
            counts[(int.from_bytes(b[i:i + Q.GRAM], "big") * 0x9E3779B97F4A7C15 % 2 ** 64) >> (64 - int(math.log2(Q.BUCKETS)))] += 1
    got = Q.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (got == counts).all()


def test_keep_is_a_number_of_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    for k in (0, 1, 123, 500, 900):
        assert Q.sample(df, Q.fit(df, labels_of(spark, corpus()), keep=k)).count() == min(k, 500)


def test_cut_and_kth_largest(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        w, g = rng.integers(-5, 5, 30).astype(float), rng.random(30) < 0.5
        if g.all() or not g.any():
            continue
        cut = Q.best_cut(w, g)
        errors = lambda c: int((g & (w < c)).sum() + (~g & (w >= c)).sum())
        assert errors(cut) == min(errors(c) for c in [-math.inf, *np.unique(w), math.inf])
    values = [*rng.normal(size=500), *[0.5] * 300, 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 100, 400, 802):
        assert Q.kth_largest(df, "v", k, bins=7) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.sample(none, Q.fit(none, no_labels)).count() == 0
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert Q.sample(df, Q.fit(df, no_labels)).count() == 500
    assert Q.sample(none, Q.fit(none, labels_of(spark, corpus()))).count() == 0


def held_out_accuracy(spark, sf, **kw):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', sf)}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter("doc_id % 2 = 0")
    kept = {r.doc_id for r in Q.sample(docs, Q.fit(docs, fit, **kw)).select("doc_id").collect()}
    held = labels.filter("doc_id % 2 = 1").collect()
    assert np.mean([r.doc_id in kept for r in held if r.quality == 1]) > 0.95
    return np.mean([(r.doc_id in kept) == (r.quality == 1) for r in held])


def test_held_out_accuracy(spark):
    assert held_out_accuracy(spark, "0.1") > 0.9
    # a thousand documents are few for the plain ratio
    assert held_out_accuracy(spark, "0.01", shaping=Q.Shaping()) > 0.9


def plain_draw(rows, labels, k, seed):
    """Weights, keys and drawn rows by the definition, one n-gram at a time."""
    bucket = lambda g: (int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2 ** 64) >> (64 - int(math.log2(Q.BUCKETS)))
    grams = lambda t: [bucket(t[i:i + Q.GRAM]) for i in range(len(t) - Q.GRAM + 1)]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if labels.get(i):
            target.update(grams(t))
    whole = [sum(c.values()) + Q.SMOOTHING * Q.BUCKETS for c in (target, raw)]
    out = []
    for i, t in rows:
        weight = sum(math.log((target[g] + Q.SMOOTHING) / whole[0]) - math.log((raw[g] + Q.SMOOTHING) / whole[1]) for g in grams(t))
        h = zlib.crc32(t, zlib.crc32(f"{seed}|{i}".encode())) << 32 | zlib.crc32(f"{i}|{seed}".encode(), zlib.crc32(t[:64]))
        h = (h ^ (h >> 31)) * 0xC2B2AE3D27D4EB4F % 2 ** 64
        h = (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2 ** 64
        out.append((weight - math.log(-math.log(((h >> 12) + 0.5) / 2 ** 52)), weight, i))
    return {i: (w, key) for key, w, i in out}, {i for *_, i in sorted(out, reverse=True)[:k]}


def test_weights_noise_and_drawn_set_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 700)                                      # texts of several pieces
    rng = random.Random(12)
    rows = corpus()[::7] + [(5000, "", 0, "z", 1), (5001, "abc", 0, "z", 1), (5002, " ".join(rng.choice(["river", "stone", "é"]) for _ in range(900)), 0, "z", 1)]
    labels = {r[0]: int(r[0] < 1000) for r in rows if r[0] % 2}
    fitted = {i for i in labels if labels[i]}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    half = {r.doc_id for r in known.selectExpr("doc_id", "pmod(shiftright(xxhash64(7, doc_id), 7), 2) AS half").collect() if r.half == 0}
    for k in (5, 40):
        sampler = Q.fit(df, known, keep=k)
        want, drawn = plain_draw([(r[0], r[1].encode()) for r in rows], {i: i in half for i in fitted}, k, 7)
        got = {r.id: (r.log_weight, r.key) for r in Q.scored(df, sampler, "doc_id", "text").collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-9) for i in want)
        assert {r.doc_id for r in Q.sample(df, sampler).collect()} == drawn


def test_draws_are_in_proportion_to_the_weights():
    rng = np.random.default_rng(5)
    weights = np.log([1.0, 2.0, 5.0])
    first = Counter(int(np.argmax(weights + Q.gumbel([0, 1, 2], [b"a", b"b", b"c"], int(s)))) for s in rng.integers(0, 1 << 30, 4000))
    assert [round(first[i] / 4000, 1) for i in range(3)] == [0.1, 0.2, 0.6] or abs(first[2] / 4000 - 5 / 8) < 0.04 > abs(first[1] / 4000 - 2 / 8)


def test_repeated_ids_clashing_label_columns_and_long_texts(spark, monkeypatch):
    rows = corpus() + [(3, "some other text of the same id, as long as any", 0, "z", 1)] * 3
    labels = labels_of(spark, corpus()).selectExpr("*", "1 AS good", "2 AS known_id", "3 AS pick", "'x' AS text", "4 AS id")
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (Q.fit(df.repartition(n), labels) for n in (2, 5))
    assert one.least == two.least and (one.ratio == two.ratio).all()
    long = ("the quiet river " * 300).encode()
    ratio = np.random.default_rng(3).normal(size=Q.BUCKETS)
    whole = Q.log_weights([b"stone", long, b""], ratio)
    monkeypatch.setattr(Q, "CHUNK", 64)
    assert np.allclose(Q.log_weights([b"stone", long, b""], ratio), whole)
