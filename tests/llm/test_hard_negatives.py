"""Hard negatives against a plain version, and the intervals against the scores they must hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, block int, place long"


def plain(rows, every=100, k=5):
    """The contract in lists; rows of (vec_id, label, vector)."""
    kept = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, label, v in sorted(kept):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for i, (label, q) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, other == label) for j, other, v in kept if j != i]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            fit = sorted((t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, **kw).collect())


def made(n, d, labels, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    at = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, d))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(0, labels)), [float(np.float32(x)) for x in v]) for i, v in enumerate(at)]


@pytest.mark.parametrize("d,labels", [(64, 10), (5, 3), (70, 2), (1, 2)])
def test_rows_against_the_plain_version(spark, monkeypatch, d, labels):
    monkeypatch.setattr(H, "BLOCK", 300)
    monkeypatch.setattr(H, "ANCHORS", 3)
    rows = made(1500, d, labels, d)
    rows += [(2000 + 100 * j, 1, rows[7][2]) for j in range(4)] + [(3001 + j, j % labels, rows[7][2]) for j in range(40)]     # a group of copies
    assert plain(rows) and mined(spark, rows) == plain(rows)


def test_one_label_and_one_vector_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 200)
    rows = made(900, 8, 4, 3)
    rows = [(i, 0 if i % 3 else label, rows[0][2] if i % 3 == 1 else v) for i, label, v in rows]
    assert mined(spark, rows) == plain(rows)


def test_rows_that_take_no_part_and_repeated_ids(spark):
    rows = made(400, 6, 3, 8)
    v = rows[5][2]
    rows += [(None, 1, v), (500, None, v), (600, 1, None), (700, 1, v[:5] + [None]), (800, 1, v[:5] + [float("nan")]),
             (900, 1, v[:5] + [float("inf")]), (901, 1, []), (1000, 2, [0.0] * 6), (1100, 1, [-x for x in v])]
    rows += [(100, 1, v), (100, 0, v), (17, 2, v), (17, 2, v)]
    want = plain(rows)
    got = mined(spark, rows + [(1200, 1, v + [1.0])])                   # of another length than most
    assert got == want and {r[0] for r in want} >= {0, 100, 200, 300}
    assert not {r[0] for r in want} & {500, 600, 700, 800, 900}


def test_huge_components_are_held_within_a_long(spark):
    rows = [(100, 1, [1e30, 1.0]), (101, 1, [1e30, 2.0]), (102, 2, [3e29, 1.0]), (103, 2, [-1e30, 1.0])]
    got = mined(spark, rows)
    most = H.largest_component(2)
    assert got == [(100, 101, 1, 102, most * most + 256 * 512, most * most + 256 * 256)] and got[0][4] < 2 ** 63


def test_empty_table_no_anchor_and_no_positive(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0])]) == []


@pytest.mark.parametrize("d", [1, 7, 64, 100])
def test_intervals_hold_every_score_and_rule_some_out(d):
    rng, turn = np.random.default_rng(d), H.rotation(d, 13)
    vectors = np.floor(256 * rng.standard_normal((500, d)))
    vectors[:3] = vectors[0]
    codes = H.Codes(vectors, turn)
    ruled = 0
    for q in vectors[::25]:
        low, high = H.bounds(codes, 0, 500, q, turn)
        scores = vectors @ q
        assert (low <= scores).all() and (scores <= high).all()
        ruled += (high < H.kth_largest(low, 5)).sum()
    assert ruled > 0


def test_plan_has_no_cross_join(spark):
    text = H.mine(spark.createDataFrame(made(300, 4, 3, 1), "vec_id long, label int, embedding array<float>"),
                  F.col("vec_id") % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
