import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF

from railguard.llm import whitening


def exact_polynomial(m):
    """det(xI - M) by Faddeev and LeVerrier, in fractions, from x^0 up."""
    n = len(m)
    a = [[Fraction(int(v)) for v in row] for row in m]
    b = [[Fraction(int(i == j)) for j in range(n)] for i in range(n)]
    c = [Fraction(1)]
    for k in range(1, n + 1):
        ab = [[sum(a[i][t] * b[t][j] for t in range(n)) for j in range(n)] for i in range(n)]
        c.append(-sum(ab[i][i] for i in range(n)) / k)
        b = [[ab[i][j] + c[-1] * (i == j) for j in range(n)] for i in range(n)]
    return [int(v) for v in reversed(c)]


def gram(seed, n, rows, top=50):
    y = np.random.default_rng(seed).integers(-top, top, (rows, n)).astype(object)
    return y.T @ y


@pytest.mark.parametrize("n,rows", [(1, 3), (2, 1), (5, 9), (6, 3), (9, 40)])
def test_polynomial_is_exact(spark, n, rows):
    m = gram(n, n, rows)
    m[:, n // 2] = m[n // 2] = 0  # a column without variance: pivots go missing
    assert whitening.characteristic_polynomial(spark, m) == exact_polynomial(m)


def test_roots_are_isolated_and_counted():
    f = [1]
    known = [0, 0, 3, 3, 3, 7, 10**6, 10**6 + 1, 10**30]
    for r in known:
        f = [a - r * b for a, b in zip([0, *f], [*f, 0])]
    assert whitening.roots_above(f, 3, 0) == 4 and whitening.roots_above(f, 5, 1) == 7
    found = whitening.largest_roots(f, 32)
    assert [(round(Fraction(a, 1 << b)), m) for a, b, m in found] == [
        (10**30, 1), (10**6 + 1, 1), (10**6, 1), (7, 1), (3, 3)
    ]
    assert all(abs(Fraction(a, 1 << b) / round(Fraction(a, 1 << b)) - 1) < Fraction(1, 2**118) for a, b, _ in found)
    assert [m for *_, m in whitening.largest_roots(f, 2)] == [1, 1]
    golden = [1, -3, 1]  # (3 +- sqrt 5) / 2
    assert [a / 2**b for a, b, _ in whitening.largest_roots(golden, 5)] == pytest.approx([(3 + 5**0.5) / 2, 2 / (3 + 5**0.5)], rel=1e-15)


def test_close_and_equal_roots_get_their_vectors(spark):
    m = np.diag([10**12, 10**12 + 1, 5, 5, 0]).astype(object)
    m[0, 1] = m[1, 0] = 1
    roots, v = whitening.components(spark, m)
    assert len(roots) == 4
    wide = 0.5 + 5**0.5 / 2
    # The close pair's vectors lie in the plane of the first two entries, (1, root - 10^12) scaled.
    assert np.allclose(np.abs(v[0, :2]), np.array([1, wide]) / np.hypot(1, wide), atol=1e-15)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-15) and np.allclose(np.abs(v[2:, 2:4]).sum(1) > 0, True)
    assert np.abs(v[2:, [0, 1, 4]]).max() < 1e-30


def brute(rows, count=32):
    """Whitening by exact integers and the library's own eigen decomposition."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    z = n * x - s
    cov = (z.T @ z).astype(float) / float(n) ** 3
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:count], v[:, ::-1][:, :count]
    return kept, n, (z * z).sum(1), (z.astype(float) / n) @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_against_brute_force(spark):
    rows = whitening.op13_whitening(spark, SF).toPandas()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, n, deviation, w, explained = brute(given)
    assert len(rows) == n * 32 and set(rows.n) == {n}
    table = rows.sort_values(["vec_id", "component"])
    order = np.argsort([i for i, _ in kept])
    assert table.vec_id.tolist() == [kept[i][0] for i in order for _ in range(32)]
    assert table.deviation.tolist() == [int(deviation[i]) for i in order for _ in range(32)]
    got = table.whitened.to_numpy().reshape(-1, 32)
    sign = np.sign((got * w[order]).sum(0))
    assert np.allclose(got * sign, w[order], atol=1e-8)
    assert np.allclose(table.explained.to_numpy().reshape(-1, 32)[0], explained, rtol=1e-9)
    assert set(rows.identity_error) == {rows.identity_error[0]} and rows.identity_error[0] < 1e-9
    cov = np.cov(got.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-9


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, n int, component string"
    draw = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in draw.normal(size=3)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("-inf"), 0.0])]
    even = [(None, good[0][1]), (3, good[3][1]), (104, [0.5]), (105, [])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in good + odd + even], schema)
    rows = whitening.whitened(spark, df).collect()
    padded = [(i, v if v is None else v + [0.0] * (3 - len(v))) for i, v in good + even]
    kept, n, deviation, w, _ = brute(padded)
    assert n == 34 and len(rows) == 34 * 3 and {r["n"] for r in rows} == {34}
    expected = sorted((str(i), int(d), round(abs(float(x)), 9)) for (i, _), d, x in zip(kept, deviation, w[:, 0]))
    assert sorted((str(r["vec_id"]), r["deviation"], round(abs(r["whitened"]), 9)) for r in rows if r["component"] == 1) == expected
    assert whitening.whitened(spark, df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [2.0, 3.0], 0, "")] * 4, schema)
    assert whitening.whitened(spark, same).count() == 0  # nothing varies
    one = spark.createDataFrame([(i, [float(i), 3.0], 0, "") for i in range(4)], schema)
    assert whitening.whitened(spark, one).count() == 4  # one of two components varies


def test_entries_outside_the_exact_range(spark):
    big = [(1, [1e18, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0])]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    rows = whitening.whitened(spark, df).collect()
    assert len(rows) == 6 and rows[0]["identity_error"] < 1e-4
    # Entries are clipped to the 64-bit range; two of the squared sums leave it.
    low, high = -(2**63), 2**63 - 1_000_001
    x = [[high, 64], [low, 128], [320, 192]]
    small = sum((3 * x[2][j] - sum(r[j] for r in x)) ** 2 for j in range(2))
    assert {(r["vec_id"], r["deviation"]) for r in rows} == {(1, None), (2, None), (3, small)}
