"""Embedding whitening through the exact characteristic polynomial of the integer scatter.

Entries become whole numbers. Tasks sum them and their products exactly, Spark adds the sums,
and ``n^2`` times the covariance is a matrix of whole numbers. Its characteristic polynomial
modulo many primes (Hessenberg reduction, one share of the primes a task) is joined by Chinese
remaindering below a proven bound; all its roots are real, so sign changes after a shift count
them exactly and bisection isolates the largest ones to ``ROOT_BITS`` bits. Inverse iteration in
fixed-point whole numbers finds a component for each root, one root a task.

Cases: rows whose vector is null or holds null, NaN or infinite entries go; a vector shorter
than the longest counts its missing entries as 0.0; an entry beyond the 64-bit range is
clipped to it; repeated rows and null ids count like any other; equal roots (closer than
``ROOT_BITS`` bits) get orthonormal components of their common space, found together, with the
sign of every component's largest entry positive; components without variance have no
whitened values and are left out, so no row is returned where nothing varies, and none for an
empty table; ``deviation`` is null where it would not fit 64 bits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railguard.llm.common import slices

COMPONENTS = 32
#: Fixed values of the whole-number form of an entry.
SCALE, SHIFT = 64.0, 1_000_000
#: Relative precision of the roots, and bits behind the point in inverse iteration.
ROOT_BITS, WORK_BITS = 120, 320
#: Rows of a task whose products are added at once.
SLICE_ROWS = 1024
#: Sums leave a task in limbs of so many bits, so that Spark's sums of limbs stay exact.
LIMB_BITS, LIMBS = 40, 5
PRIMES_PER_TASK = 8

_LOWEST, _HIGHEST = -(2**63), 2**63 - 1 - SHIFT


def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    double = vector.cast("array<double>")
    bad = F.exists(double, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(part: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of list entries as a (rows, width) array; the shift of 1000000 cancels.

    int64, or Python integers where an entry's square could leave the exact range.
    """
    ends = part.offsets.to_numpy().astype(np.int64)
    flat = part.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.float64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(SCALE * flat)
    if not out.size or np.abs(out).max() < 2.0**52:
        return out.astype(np.int64)
    # int() of an infinite product (an entry near the end of the double range) clips as well.
    clip = lambda v: _HIGHEST if v >= float(_HIGHEST) else _LOWEST if v <= float(_LOWEST) else int(v)
    return np.frompyfunc(clip, 1, 1)(out)


def products(y: np.ndarray) -> np.ndarray:
    """Exact y'y as Python integers or int64."""
    if y.dtype == object:
        return y.T @ y
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 2**53:  # exact in doubles, which the fast product uses
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if top * top * len(y) < 2**63:
        return y.T @ y
    o = y.astype(object)
    return o.T @ o


def _limbs(value: int) -> list[int]:
    """Low limbs are non-negative, the last one carries the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _cell_sums(df: DataFrame, schema_cells: int, matrices) -> tuple[int, list[int]]:
    """Rows and exact sums over all tasks of ``matrices(batch)``: lists of whole numbers.

    At most ``schema_cells`` rows leave a task, and as many come back.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        rows, sums = 0, None
        for part in slices(batches, SLICE_ROWS):
            found = np.array([int(v) for v in matrices(part)], object)
            sums = found if sums is None else sums + found
            rows += part.num_rows
        if sums is None:
            return
        values = [rows, *sums.tolist()]
        columns = [pa.array(range(len(values)), pa.int32())]
        columns += [pa.array(c, pa.int64()) for c in zip(*map(_limbs, values))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", *[f"l{k}" for k in range(LIMBS)]])

    limbs = [f"l{k}" for k in range(LIMBS)]
    partial = df.mapInArrow(run, "cell int, " + ", ".join(f"{c} bigint" for c in limbs))
    total = partial.groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in limbs])
    values = [0] * (schema_cells + 1)
    for r in total.collect():
        values[r["cell"]] = sum(int(r[c]) << (LIMB_BITS * k) for k, c in enumerate(limbs))
    return values[0], values[1:]


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of floor(64 c), and M = n Y'Y - S S' (n^2 times the covariance), exact."""
    upper = np.triu_indices(width)

    def matrices(part: pa.RecordBatch):
        y = whole(part.column(0), width)
        sums = y.astype(object).sum(0) if len(y) else [0] * width
        return [*sums, *products(y)[upper].tolist()]

    n, cells = _cell_sums(vectors.select("v"), width + len(upper[0]), matrices)
    s = cells[:width]
    m = np.zeros((width, width), object)
    for value, i, j in zip(cells[width:], *upper):
        m[i, j] = m[j, i] = n * value - s[i] * s[j]
    return n, s, m


# --- characteristic polynomial -------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.4e12 with these witnesses."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product exceeds ``2 * bound + 1``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= 2 * bound + 1:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """det(xI - M) modulo ``p``, coefficients from x^0 up, by Hessenberg reduction."""
    h = (m % p).astype(np.int64)
    size = len(h)
    for k in range(1, size - 1):
        below = np.nonzero(h[k:, k - 1])[0]
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        if factors.any():
            h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k][None, :] % p) % p
            # One column takes a sum of products below p^2 < 2^62 each: reduce before adding.
            h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors[None, :] % p).sum(1)) % p
    polys = [np.zeros(size + 1, np.int64)]
    polys[0][0] = 1
    for k in range(size):
        nxt = np.roll(polys[k], 1)
        nxt = (nxt - int(h[k, k]) * polys[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            nxt = (nxt - int(h[i, k]) * chain % p * polys[i] % p) % p
        polys.append(nxt)
    return polys[size].tolist()


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """det(xI - M) of a positive semidefinite whole-number matrix, from x^0 up.

    The roots are not negative and add up to the trace, so by Maclaurin's inequality no
    coefficient exceeds ``C(d, k) (trace / d)^k``: enough primes make the result exact.
    """
    size, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    bound = max(comb(size, k) * trace**k // size**k + 1 for k in range(size + 1))
    primes = primes_for(bound)
    # One matrix of size x size whole numbers: its size depends on the vectors' width alone.
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([polynomial_mod(shared.value, p)], pa.list_(pa.int64()))],
                    ["p", "c"],
                )

    table = spark.createDataFrame([(p,) for p in primes], "p bigint")
    rows = table.repartition(-(-len(primes) // PRIMES_PER_TASK)).mapInArrow(run, "p bigint, c array<bigint>").collect()
    modulus, joined = 1, [0] * (size + 1)
    for r in rows:
        p, inverse = r["p"], pow(modulus, -1, r["p"])
        joined = [a + modulus * ((c - a) * inverse % p) for a, c in zip(joined, r["c"])]
        modulus *= p
    return [a - modulus if a > modulus // 2 else a for a in joined]


# --- roots ---------------------------------------------------------------------------------


def roots_above(f: list[int], num: int, bits: int) -> int:
    """Roots greater than ``num / 2^bits``, counted with multiplicity; all roots must be real.

    By Descartes' rule, which is exact for real-rooted polynomials: the sign changes of the
    coefficients of f(x + a), scaled to whole numbers.
    """
    size = len(f) - 1
    c = [v << (bits * (size - i)) for i, v in enumerate(f)]
    for i in range(size):
        for j in range(size - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _at(f: list[int], num: int, bits: int) -> int:
    """The sign of f(num / 2^bits)."""
    value, shift = f[-1], 0
    for v in reversed(f[:-1]):
        shift += bits
        value = value * num + (v << shift)
    return (value > 0) - (value < 0)


def largest_roots(f: list[int], count: int) -> list[tuple[int, int, int]]:
    """The largest positive roots as (numerator, bits, multiplicity), falling.

    A root is numerator / 2^bits to ``ROOT_BITS`` bits; roots that stay together at that
    precision are one entry with their number. Intervals are halved until each holds one
    root (counted exactly), then one sign of f decides each further half.
    """
    zeros = next(i for i, v in enumerate(f) if v)
    f = f[zeros:]
    found: list[tuple[int, int, int]] = []
    if len(f) < 2:
        return found
    # No root exceeds their sum. Intervals are (low, low + 2^width], low a numerator over 2^bits.
    waiting, taken = [(0, 0, (-f[-2]).bit_length(), 0, len(f) - 1)], 0
    while waiting and taken < count:
        low, bits, width, above_high, above_low = waiting.pop()
        inside = above_low - above_high
        if not inside:
            continue
        low, bits, middle = _halved(low, bits, width)
        if _precise(low, bits, width):
            found.append((middle, bits, inside))
        elif inside == 1 and low:
            found.append((*_bisect(f, low, bits, width), 1))
        else:
            above = roots_above(f, middle, bits)
            waiting.append((low, bits, width - 1, above, above_low))
            waiting.append((middle, bits, width - 1, above_high, above))
            continue
        taken += inside
    return found


def _halved(low: int, bits: int, width: int) -> tuple[int, int, int]:
    """low, bits and the middle of the interval, over a denominator that can express it."""
    if bits + width < 1:
        low, bits = low << (1 - bits - width), 1 - width
    return low, bits, low + (1 << (bits + width - 1))


def _precise(low: int, bits: int, width: int) -> bool:
    return low > 0 and low.bit_length() - bits - width > ROOT_BITS


def _bisect(f: list[int], low: int, bits: int, width: int) -> tuple[int, int]:
    """The one root in (low, low + 2^width] by signs of f; its numerator and bits."""
    start = _at(f, low, bits)
    if start == 0:
        # The low end is another root (the interval is open there): the sign just above it.
        start = _at(f, (low << (2 * ROOT_BITS)) + 1, bits + 2 * ROOT_BITS)
    low, bits, middle = _halved(low, bits, width)
    while not _precise(low, bits, width):
        sign = _at(f, middle, bits)
        if sign == 0:
            break
        if sign == start:
            low = middle
        width -= 1
        low, bits, middle = _halved(low, bits, width)
    return middle, bits


# --- components ----------------------------------------------------------------------------


def null_space(m: np.ndarray, num: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of M's (nearly) null space at num / 2^bits, as doubles.

    Inverse iteration with a pivoted LU in fixed-point whole numbers, ``WORK_BITS`` bits
    relative to the matrix: the error is far below a double's, however close other roots are
    down to the roots' precision.
    """
    size = len(m)
    scale = max(1, max(abs(int(v)) for v in m.ravel())).bit_length()
    up = WORK_BITS - scale
    a = np.array([[int(v) << up if up >= 0 else int(v) >> -up for v in row] for row in m], object)
    root = (num << (up - bits)) if up >= bits else (num >> (bits - up))
    for i in range(size):
        a[i, i] -= root
    order = list(range(size))
    for k in range(size):
        pivot = max(range(k, size), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1  # one unit in the last place: the solution grows along the null space
        if k + 1 < size:
            factors = (a[k + 1 :, k] << WORK_BITS) // a[k, k]
            a[k + 1 :, k] = factors
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :][None, :]) >> WORK_BITS
    draw = np.random.default_rng(size)
    block = [np.array([int(v) << (WORK_BITS - 40) for v in draw.integers(-(2**40), 2**40, size)], object) for _ in range(count)]
    for _ in range(4):
        solved = []
        for b in block:
            x = b[order]
            for k in range(1, size):
                x[k] -= int(a[k, :k] @ x[:k]) >> WORK_BITS
            for k in range(size - 1, -1, -1):
                rest = x[k] - (int(a[k, k + 1 :] @ x[k + 1 :]) >> WORK_BITS) if k + 1 < size else x[k]
                x[k] = (int(rest) << WORK_BITS) // int(a[k, k])
            top = max(1, max(abs(int(v)) for v in x)).bit_length() - WORK_BITS
            x = np.array([int(v) >> top if top >= 0 else int(v) << -top for v in x], object)
            for other in solved:
                x = x - ((other * (int(other @ x) >> WORK_BITS)) >> WORK_BITS)
            norm = isqrt(int(x @ x))
            solved.append((x << WORK_BITS) // norm)
        block = solved
    out = np.array([[float(int(v) / (1 << WORK_BITS)) for v in x] for x in block])
    sign = np.sign(out[np.arange(count), np.abs(out).argmax(1)])
    return out * sign[:, None]


def components(spark: SparkSession, m: np.ndarray, count: int = COMPONENTS) -> tuple[list[float], np.ndarray]:
    """The ``count`` largest roots of M and their unit vectors (rows), falling."""
    f = characteristic_polynomial(spark, m)
    found = largest_roots(f, count)
    if not found:
        return [], np.zeros((0, len(m)))
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            for i, num, bits, times in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = null_space(shared.value, int(num), bits, times).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["i", "v"]
                )

    rows = [(i, str(num), bits, times) for i, (num, bits, times) in enumerate(found)]
    table = spark.createDataFrame(rows, "i int, num string, bits int, times int").repartitionByRange(len(rows), "i")
    vectors = {r["i"]: r["v"] for r in table.mapInArrow(run, "i int, v array<array<double>>").collect()}
    roots = [num / (1 << bits) for num, bits, times in found for _ in range(times)]
    return roots[:count], np.array([v for i in range(len(found)) for v in vectors[i]])[:count]


# --- whitening -----------------------------------------------------------------------------


def whitened(spark: SparkSession, embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error."""
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    kept = embeddings.filter(usable(F.col("embedding"))).select(
        F.col("embedding").cast("array<double>").alias("v"), F.col("vec_id").cast("bigint").alias("vec_id")
    )
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    nothing = spark.createDataFrame([], schema)
    if not width:
        return nothing
    n, s, m = scatter(kept, width)
    roots, vectors = components(spark, m, count)
    if not roots:
        return nothing
    trace = int(sum(m[i, i] for i in range(width)))
    explained = [r / trace for r in roots]
    # Whitened: (n y - S) . v / sqrt(root of M), because M is n^2 times the covariance.
    directions = (vectors / np.sqrt(np.array(roots))[:, None]).T

    def centred(part: pa.Array) -> np.ndarray:
        y = whole(part, width)
        big = y.dtype == object or int(np.abs(y).max(initial=0)) * n + max(map(abs, s)) >= 2**62
        return n * (y.astype(object) if big else y) - np.array(s, object if big else np.int64)

    def project(z: np.ndarray) -> np.ndarray:
        return z.astype(np.float64) @ directions

    upper = np.triu_indices(len(roots))

    def moments(part: pa.RecordBatch):
        # Sums of doubles as whole numbers of 2^-60: exact additions, so no order matters.
        w = project(centred(part.column(0)))
        both = np.concatenate([w.sum(0), (w.T @ w)[upper]])
        return [int(round(v * 2.0**60)) for v in both.tolist()]

    _, cells = _cell_sums(kept.select("v"), len(roots) + len(upper[0]), moments)
    mean = np.array([c / (n << 60) for c in cells[: len(roots)]])
    cov = np.array([c / (n << 60) for c in cells[len(roots) :]]) - mean[upper[0]] * mean[upper[1]]
    error = float(np.abs(cov - (upper[0] == upper[1])).max())

    def run(batches):
        for part in slices(batches, SLICE_ROWS):
            z = centred(part.column(0))
            deviation = _square_sums(z)
            w, k = project(z), len(roots)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("v", "vec_id").mapInArrow(run, schema)


def _square_sums(z: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; None beyond 64 bits."""
    if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * max(z.shape[1], 1) < 2**63:
        return (z * z).sum(1).tolist()
    sums = [sum(int(v) * int(v) for v in row) for row in z.tolist()]
    return [v if v < 2**63 else None for v in sums]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
