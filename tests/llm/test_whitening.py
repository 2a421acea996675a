"""Whitening against exact and floating plain versions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.llm import queries as Q
from ledgerline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component int, place int, x int"


def leverrier(a):
    """Characteristic polynomial by Faddeev and LeVerrier, lowest first, in fractions."""
    d = len(a)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(Fraction(a[i][t]) * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(Fraction(a[i][t]) * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(c) for c in reversed(out)]


def plain(rows, components=32, scale=64, offset=1_000_000):
    """(id -> (deviation, whitened up to sign), explained) with eigenvectors of LAPACK."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(scale * c)) + offset for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    centred = x * n - s
    deviation = [int(sum(c * c for c in row)) for row in centred]
    c = centred.astype(np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    keep = e > 1e-9 * e[0]
    e, v = e[keep][:components], v[:, keep][:, :components]
    return [i for i, _ in kept], n, deviation, np.abs(c @ v / np.sqrt(e)), e / (c * c).sum() * n


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    out = {}
    for r in W.whiten(df, **kw).collect():
        out.setdefault(r.id, []).append(r)
    return {i: sorted(rs, key=lambda r: r.component) for i, rs in out.items()}


def agree(got, rows, **kw):
    ids, n, deviation, w, explained = plain(rows, **kw)
    assert sorted(got) == sorted(ids)
    for i, dev, row in zip(ids, deviation, w, strict=True):
        assert [r.component for r in got[i]] == list(range(1, len(row) + 1))
        assert all(r.n == n and r.deviation == dev and r.identity_error < 1e-10 for r in got[i])
        assert np.allclose(np.abs([r.whitened for r in got[i]]), row, atol=1e-8, rtol=1e-8)
        assert np.allclose([r.explained for r in got[i]], explained, rtol=1e-12)


def made(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((n, d)) * np.linspace(1, 3, d) + rng.standard_normal(d))]


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial_and_roots_are_exact(spark, d):
    rng = np.random.default_rng(d)
    b = rng.integers(-10 ** 6, 10 ** 6, (d + 3, d)).astype(object)
    a = b.T @ b
    a[:, 0], a[0, :] = 0, 0                                               # a root at zero, and a column with no pivot
    poly = W.characteristic_polynomial(spark, a)
    assert poly == leverrier(a.tolist())
    poly = poly[next(i for i, c in enumerate(poly) if c):]
    want = np.linalg.eigvalsh(a.astype(np.float64))[::-1]
    for k in range(1, len(poly)):
        root, many, place = W.kth_root(poly, k)
        assert (many, place) == (1, 0) and float(root) == pytest.approx(want[k - 1], rel=1e-12)
        v = W.null_space(a, root, 1)[0]
        assert np.abs(a.astype(np.float64) @ v - float(root) * v).max() < 1e-12 * want[0]


def test_roots_of_any_multiplicity_and_near_each_other():
    poly = [1]
    roots = [3] * 4 + [7, 7] + [10 ** 12, 10 ** 12 + 1, 50]
    for r in roots:
        poly = [x - r * y for x, y in zip([0, *poly], [*poly, 0], strict=True)]
    for k, want in enumerate(sorted(roots, reverse=True), 1):
        root, many, place = W.kth_root(poly, k)
        assert float(root) == want and many == roots.count(want)
        assert place == k - 1 - sum(r > want for r in roots)
    assert W.roots_above(poly, 7, 0) == 3 and W.roots_above(poly, 13, 1) == 5 and W.sign_at(poly, 3, 0) == 0


def test_near_eigenvalues_keep_their_vectors_to_double_precision():
    rng = np.random.default_rng(2)
    turn = np.array([[int(x) for x in row] for row in rng.integers(-9, 9, (4, 4))], object)
    basis = turn.T @ turn * 10 ** 9 + np.diag([1, 2, 3, 4]).astype(object)
    poly = leverrier(basis.tolist())
    vectors = np.array([W.component(basis, poly, k)[1] for k in range(1, 5)])
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-14


def test_exact_sums_of_any_size():
    for most in (100, 1 << 26, 1 << 40, W.LARGEST):
        y = np.random.default_rng(1).integers(-most, most, (50, 4))
        o = y.astype(object)
        assert (W.exact_gram(y) == o.T @ o).all() and (W.exact_sums(y) == o.sum(axis=0)).all()
        g = (o.T @ o).ravel()
        assert (W.from_limbs(W.to_limbs(g, W.LIMBS) + W.to_limbs(g, W.LIMBS), W.LIMBS) == 2 * g).all()


def test_rows_against_the_plain_version(spark):
    rows = made(300, 6, 1) + [(400, None), (401, []), (402, [1.0] * 5 + [None]), (403, [1.0] * 5 + [float("nan")]),
                              (404, [1.0] * 5 + [float("-inf")]), (405, [0.0] * 6)]
    got = whitened(spark, rows + [(406, [1.0] * 7)])
    agree(got, rows)
    assert 405 in got and not {400, 401, 402, 403, 404, 406} & set(got)
    few = whitened(spark, rows, components=2)
    agree(few, rows, components=2)


def test_copies_and_dependent_dimensions(spark):
    rows = [(i, [*v[:3], v[0], 0.25]) for i, v in made(120, 5, 4)]           # one dimension twice, one constant
    rows += [(1000 + i, rows[0][1]) for i in range(60)]                       # a third of all rows is one vector
    got = whitened(spark, rows)
    agree(got, rows)
    assert len(got[0]) == 3


def test_equal_eigenvalues_get_an_orthonormal_basis(spark):
    rows = [(2 * j + s, [float(1 - 2 * s) * (i == j) for i in range(4)]) for j in range(4) for s in (0, 1)]
    got = whitened(spark, rows)
    w = np.array([[r.whitened for r in got[i]] for i in sorted(got)])
    assert w.shape == (8, 4) and np.abs(w.T @ w / 8 - np.eye(4)).max() < 1e-12
    assert all(r.explained == pytest.approx(0.25, abs=1e-15) and r.identity_error < 1e-12 for rs in got.values() for r in rs)


def test_large_entries_and_a_deviation_beyond_a_long(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [5.0, 3.0])]
    got = whitened(spark, rows)
    assert got[1][0].deviation is None and abs(got[1][0].whitened) == pytest.approx(np.sqrt(1.5), rel=1e-12)
    assert got[1][0].identity_error < 1e-10
    assert len(whitened(spark, [(1, [1e300]), (2, [0.0])])) == 2              # held within LARGEST


def test_repeated_null_and_text_ids_and_nothing_to_whiten(spark):
    rows = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 1.0]), (8, [0.0, 0.5])]
    got = whitened(spark, rows)
    assert {i: len(r) for i, r in got.items()} == {7: 4, None: 2, 8: 2}
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        assert whitened(spark, none) == {}
    text = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<double>")
    assert {r.id for r in W.whiten(text).collect()} == {"a", "b"}


def test_the_query_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", F.col("embedding")).collect()]
    got = {}
    for r in Q.queries()["op12_whitening"](spark, SF_SMALL).withColumnRenamed("vec_id", "id").collect():
        got.setdefault(r.id, []).append(r)
    agree({i: sorted(rs, key=lambda r: r.component) for i, rs in got.items()}, rows)
    assert len(got[rows[0][0]]) == 32
