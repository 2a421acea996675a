"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Components of the vectors become integers, so their scatter matrix A = n^2 V is
an integer matrix that tasks sum exactly.  Its characteristic polynomial is
found modulo many primes, each by reduction to Hessenberg form in a task of its
own, and put together by the Chinese remainder theorem.  All its roots are real,
so the sign changes of its shifted coefficients count the roots above any point
exactly (Descartes); halving isolates the k-th largest root, whatever its
multiplicity, and signs of the polynomial narrow it to high precision.  The
component is the null space of A minus the root, by inverse iteration in
decimals of as many digits.  Each component is a task of its own, too.
"""

from __future__ import annotations

import decimal
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import matrix
from .common import free_name, materialise, summed_vectors

#: Components of vectors stay within this size, so that differences of them fit a long.
LARGEST = 1 << 61
#: Bits of a root, relative to it; roots nearer than CLUSTER bits to each other count as one of higher multiplicity.
ROOT_BITS, CLUSTER = 256, 160
LIMB, LIMBS, SUM_LIMBS = 30, 6, 4


# ------------------------------------------------------------------- exact sums
def to_limbs(values: np.ndarray, limbs: int) -> np.ndarray:
    """Integers of any size as ``limbs`` longs of LIMB bits each (the last keeps the sign); sums of limbs are limbs of sums."""
    out = np.empty((limbs, len(values)), np.int64)
    for i in range(limbs - 1):
        out[i] = (values & ((1 << LIMB) - 1)).astype(np.int64)
        values = values >> LIMB
    out[-1] = values.astype(np.int64)
    return out.ravel()


def from_limbs(numbers: np.ndarray, limbs: int) -> np.ndarray:
    return sum((row.astype(object) << (LIMB * i) for i, row in enumerate(numbers.reshape(limbs, -1))), 0)


def exact_sums(x: np.ndarray) -> np.ndarray:
    return ((x >> 31).sum(axis=0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """The sum of y y^T over the rows, exact for longs of any size: products of limbs stay below 2^53."""
    total = np.zeros((y.shape[1],) * 2, object)
    for rows in np.array_split(y, -(-len(y) // 4096)):
        if int(np.abs(rows).max()) ** 2 * len(rows) < 1 << 53:
            f = rows.astype(np.float64)
            total = total + (f.T @ f).astype(np.int64).astype(object)
            continue
        limbs = [((rows >> (20 * i)) & ((1 << 20) - 1) if i < 3 else rows >> 60).astype(np.float64) for i in range(4)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << (20 * (i + j)))
    return total


def summed(rows: DataFrame, size: int, limbs: int, count) -> np.ndarray:
    """Exact sums of the ``size`` integers that ``count`` makes of each batch's matrix."""
    parts = 16
    width = -(-size * limbs // parts) * parts

    def task(batches):
        total = np.zeros(size, object)
        for batch in batches:
            if len(batch):
                total = total + count(matrix(batch.column(0)))
        out = np.zeros(width, np.int64)
        out[:size * limbs] = to_limbs(total, limbs)
        return out
    return from_limbs(summed_vectors(rows, task, width, parts)[:size * limbs], limbs)


# ------------------------------------------------- the characteristic polynomial
def primes_below(top: int, product_over: int) -> list[int]:
    """The largest primes below ``top`` (at most 2^31) whose product exceeds ``product_over``."""
    out, product, p = [], 1, top
    while product <= product_over:
        p -= 1
        if p % 2 and all(p % q for q in (3, 5, 7, 11, 13)) and _prime(p):
            out.append(p)
            product *= p
    return out


def _prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every n below 3,215,031,751."""
    s = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, n - 1 >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(t - a) modulo a prime below 2^31, by Hessenberg form."""
    h, d = (a % p).astype(np.int64), len(a)
    for j in range(d - 2):
        nonzero = np.nonzero(h[j + 1:, j])[0]
        if not len(nonzero):
            continue
        i = j + 1 + int(nonzero[0])
        if i != j + 1:
            h[[i, j + 1]] = h[[j + 1, i]]
            h[:, [i, j + 1]] = h[:, [j + 1, i]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)                              # of the leading blocks of each size
    leading[0, 0] = 1
    for k in range(1, d + 1):
        below, factors = 1, [int(h[k - 1, k - 1])]
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            factors.append(int(h[k - i - 1, k - 1]) * below % p)
        drop = (np.array(factors, np.int64)[:, None] * leading[k - 1::-1][:k] % p).sum(axis=0)
        leading[k] = (np.roll(leading[k - 1], 1) - drop) % p
    return leading[d].tolist()


def by_remainders(found: list[tuple[int, list[int]]]) -> list[int]:
    """Integers, of at most half the primes' product in size, from their residues."""
    product, values = 1, [0] * len(found[0][1])
    for p, residues in found:
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, residues, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(t - a) for a positive semidefinite integer matrix.

    By the means of the eigenvalues no coefficient exceeds (1 + trace / d)^d: so many primes are taken, one row each.
    """
    d, trace = len(a), int(sum(a.diagonal()))
    primes = primes_below(1 << 31, 2 * (trace // d + 2) ** d)
    shared = spark.sparkContext.broadcast(a)                                  # dimensions x dimensions integers

    def task(batches):
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_mod(shared.value, p) for p in ps],
                                                                                 pa.list_(pa.int64()))], names=["p", "residues"])
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64)).mapInArrow(task, "p long, residues array<long>")
    out = by_remainders([(r["p"], r["residues"]) for r in rows.collect()])     # primes: they grow with the digits of the rows' count
    if out[d] != 1 or out[d - 1] != -trace:
        raise ArithmeticError("the characteristic polynomial does not have the matrix's trace")
    return out


# ------------------------------------------------------------------------ roots
def roots_above(poly: list[int], num: int, shift: int) -> int:
    """Roots, with multiplicity, greater than num / 2^shift of a polynomial with real roots only."""
    d = len(poly) - 1
    c = [x << shift * (d - i) for i, x in enumerate(poly)][::-1]               # highest first, in units of 2^-shift
    for length in range(d + 1, 1, -1):
        c[:length] = accumulate(c[:length], lambda high, low: high * num + low)
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], num: int, shift: int) -> int:
    value, unit = 0, 1
    for x in reversed(poly):
        value = value * num + x * unit
        unit <<= shift
    return (value > 0) - (value < 0)


def kth_root(poly: list[int], k: int) -> tuple[Fraction, int, int]:
    """The k-th largest root of a polynomial with real roots only, none below zero: (root, its multiplicity, k's place among them).

    The root is positive.  It lies in (lo, hi] / 2^shift throughout.
    """
    lo, hi, shift = 0, -poly[-2], 0                                            # their sum is above none of them
    above_lo, above_hi = roots_above(poly, 0, 0), roots_above(poly, hi, 0)
    while above_lo - above_hi > 1 and (hi - lo) << CLUSTER > lo:
        if hi - lo == 1:
            lo, hi, shift = 2 * lo, 2 * hi, shift + 1
        mid = lo + hi >> 1
        above = roots_above(poly, mid, shift)
        if above >= k:
            lo, above_lo = mid, above
        else:
            hi, above_hi = mid, above
    if above_lo - above_hi == 1:
        while (hi - lo) << ROOT_BITS > lo:
            if hi - lo == 1:
                lo, hi, shift = 2 * lo, 2 * hi, shift + 1
            mid = lo + hi >> 1
            if sign_at(poly, mid, shift) == (-1) ** (above_hi + 1):            # the sign of one more root above
                lo = mid
            else:
                hi = mid
    return Fraction(lo + hi, 2 << shift), above_lo - above_hi, k - above_hi - 1


# ------------------------------------------------------------------- components
def null_space(a: np.ndarray, root: Fraction, dimensions: int) -> np.ndarray:
    """Orthonormal rows that span the null space of a - root, by inverse iteration in decimals."""
    d = len(a)
    digits = int((ROOT_BITS + max(abs(int(x)) for x in a.ravel()).bit_length()) * 0.302) + 40
    with decimal.localcontext(decimal.Context(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        whole = np.vectorize(lambda x: decimal.Decimal(int(x)), otypes=[object])
        m = whole(a)
        m[np.arange(d), np.arange(d)] -= decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        scale = max(abs(x) for x in m.ravel()) or decimal.Decimal(1)
        tiny, order = scale.scaleb(-digits + 20), np.arange(d)
        for j in range(d):                                                     # triangular factors, in place
            i = j + int(np.argmax(np.abs(m[j:, j])))
            if i != j:
                m[[i, j]], order[[i, j]] = m[[j, i]], order[[j, i]]
            if abs(m[j, j]) < tiny:
                m[j, j] = tiny
            m[j + 1:, j] = m[j + 1:, j] / m[j, j]
            m[j + 1:, j + 1:] = m[j + 1:, j + 1:] - m[j + 1:, j, None] * m[j, j + 1:]
        space = whole(np.random.default_rng(d).integers(-999, 1000, (dimensions, d)))
        for _ in range(3):
            out = []
            for b in space:
                x = b[order]
                for j in range(d):
                    x[j + 1:] = x[j + 1:] - m[j + 1:, j] * x[j]
                for j in range(d - 1, -1, -1):
                    x[j] = x[j] / m[j, j]
                    x[:j] = x[:j] - m[:j, j] * x[j]
                x = x / max(abs(v) for v in x)
                for _ in range(2):
                    for y in out:
                        x = x - y * (x @ y)
                out.append(x / (x @ x).sqrt())
            space = out
        return np.array(space).astype(np.float64)


def component(a: np.ndarray, poly: list[int], k: int) -> tuple[Fraction, np.ndarray]:
    """The k-th largest eigenvalue and its unit vector (of equal eigenvalues, one of an orthonormal basis; its largest entry is positive)."""
    root, many, place = kth_root(poly, k)
    v = null_space(a, root, many)[place]
    return root, v * np.sign(v[np.argmax(np.abs(v))])


class Whitening:
    """Fitted: n, sums, and for each component its eigenvalue of V (as a fraction), its vector, its share of the trace."""

    def __init__(self, n: int, sums: list[int], values: list[Fraction], vectors: np.ndarray, explained: list[float]):
        self.n, self.sums, self.values, self.vectors, self.explained = n, sums, values, vectors, explained
        self.scaled = vectors.T / np.sqrt([float(v) for v in values]) if len(values) else np.zeros((len(sums), 0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else integers of any size."""
        most = int(np.abs(x).max()) * self.n + max(abs(s) for s in self.sums)
        return x * self.n - np.array(self.sums) if most < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)

    def transform(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.scaled

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        """The exact sums of squares; None beyond a long."""
        if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in centred.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def integer_rows(table: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> tuple[DataFrame, int]:
    """(id, x) of the rows that remain, x longs, and their dimensions (the commonest length)."""
    most = F.lit(float(LARGEST))
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter(
        "vector IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    first = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = first["d"] if first else 0
    x = F.transform("vector", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), -most), most)) + F.lit(offset).cast("long"))
    return rows.filter(F.size("vector") == d).select("id", x.alias("x")), d


def fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of all ``rows`` (id, x); None if there are none."""
    spark = rows.sparkSession
    x = rows.select("x")
    totals = summed(x, d + 1, SUM_LIMBS, lambda m: np.append(exact_sums(m), len(m)))
    n, sums = int(totals[d]), [int(s) for s in totals[:d]]
    if not n:
        return None
    middle = np.array([s // n for s in sums], np.int64)                        # centred before multiplying; the rest of the mean is exact below
    upper = np.triu_indices(d)
    found = summed(x, len(upper[0]), LIMBS, lambda m: exact_gram(m - middle)[upper])
    gram = np.zeros((d, d), object)
    gram[upper] = found
    gram.T[upper] = found
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)
    a = gram * n - np.outer(rest, rest)                                        # n^2 V
    trace = int(sum(a.diagonal()))
    if not trace:
        return Whitening(n, sums, [], np.zeros((0, d)), [])
    poly = characteristic_polynomial(spark, a)
    poly = poly[next(i for i, c in enumerate(poly) if c):]                     # roots at zero fall away
    shared = spark.sparkContext.broadcast((a, poly))

    def task(batches):
        for batch in batches:
            out = [component(*shared.value, k) for k in batch.column(0).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(r) for r, _ in out]), pa.array([v.tolist() for _, v in out])],
                                                 names=["k", "root", "vector"])
    count = min(components, len(poly) - 1)
    got = sorted(spark.range(1, count + 1).withColumnRenamed("id", "k").repartition(count).mapInArrow(
        task, "k long, root string, vector array<double>").collect())          # one row per component
    roots = [Fraction(r["root"]) for r in got]
    return Whitening(n, sums, [r / n ** 2 for r in roots], np.array([r["vector"] for r in got]), [float(r / trace) for r in roots])


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n, centred before multiplying) minus the identity.

    Tasks merge the means and centred products of their batches; the partial results, one row a task, are added by Spark.
    """
    k, own = len(fitted.values), rows.sparkSession.sparkContext.broadcast(fitted)

    def task(batches):
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = own.value.transform(own.value.centred(matrix(batch.column(0))))
                m, at = len(w), w.mean(axis=0)
                w = w - at
                square += w.T @ w + np.outer(at - mean, at - mean) * (n * m / (n + m))
                mean += (at - mean) * (m / (n + m))
                n += m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([square.ravel().tolist()])],
                                             names=["n", "mean", "square"])
    parts = materialise(rows.select("x").mapInArrow(task, "n long, mean array<double>, square array<double>"), "covariances")

    def added(values) -> np.ndarray:
        at = parts.select(F.posexplode(values)).groupBy("pos").agg(F.sum("col").alias("total")).collect()      # components, squared at most
        return np.array([r["total"] for r in sorted(at)])
    mean = added(F.transform("mean", lambda v: v * F.col("n"))) / fitted.n
    centre = F.array(*[F.lit(float(v)) for v in mean])
    off = F.zip_with("mean", centre, lambda v, c: v - c)
    products = F.flatten(F.transform(off, lambda v: F.transform(off, lambda u: u * v * F.col("n"))))
    square = added(F.zip_with("square", products, lambda s, p: s + p)) / fitted.n
    return float(np.abs(square.reshape(k, k) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float = 64.0,
           offset: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every row on its first components.

    Entries become x = floor(scale * entry) + offset.  With n rows of sums S, ``deviation`` is the exact sum of
    (n x - S)^2 over the dimensions (null beyond a long), ``whitened`` the projection of x - S / n on the component over the root of its
    eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` how far the covariance of
    ``whitened`` is from the identity, measured over all rows.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries are dropped; entries are held
    within 2^61.  Repeated rows and ids and null ids are rows like others.  Only eigenvalues above zero
    have components: fewer than ``components`` where the rows span fewer dimensions, none for a single or
    constant vector or an empty table, whose result is empty.  Equal eigenvalues get an orthonormal basis of
    their space.  Other columns take no part.
    """
    spark = table.sparkSession
    kind = table.schema[id_col].dataType.simpleString()
    rows, d = integer_rows(table, id_col, vector_col, scale, offset)
    fitted = fit(rows, d, components) if d else None
    if fitted is None or not fitted.values:
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    own, error = spark.sparkContext.broadcast(fitted), identity_error(rows, fitted)

    def task(batches):
        for batch in batches:
            if len(batch):
                centred = own.value.centred(matrix(batch.column(1)))
                w = own.value.transform(centred)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own.value.deviation(centred), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))],
                    names=["id", "deviation", "w"])
    shares = F.array(*[F.lit(v) for v in fitted.explained])
    place = free_name(rows, "place")
    return rows.mapInArrow(task, f"id {kind}, deviation long, w array<double>").select(
        "id", "deviation", F.posexplode("w").alias(place, "whitened")).select(
        "id", (F.col(place) + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col(place) + 1).alias("explained"), F.lit(error).alias("identity_error"))
