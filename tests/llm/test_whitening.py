import math

import numpy as np
import pytest

from lectern.llm.whitening import deviations, whiten


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    return df.selectExpr("*", "1 as n", "2 as f", "'x' as component", "3 as pos") if extra else df


def brute(rows, count):
    width = max((len(v) for _, v, _ in rows if v and all(e is not None and math.isfinite(e) for e in v)), default=0)
    kept = [(i, v) for i, v, _ in rows if v and len(v) == width and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in kept]
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return [i for i, _ in kept], deviation, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def table(spark, rows, count, extra=False):
    got = whiten(frame(spark, rows, extra), count=count).collect()
    k = max((r["component"] for r in got), default=0)
    ids = sorted({r["vec_id"] for r in got})
    white = np.zeros((len(ids), k))
    for r in got:
        white[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
    return got, ids, white


def signs(a, b):
    return a * np.sign((a * b).sum(axis=0))


def test_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(5)
    data = r.standard_normal((300, 12)) @ np.diag(np.linspace(3, 0.3, 12)) @ r.standard_normal((12, 12))
    rows = [(i, [float(e) for e in v], None) for i, v in enumerate(data)]
    odd = [(900, None, 1), (901, [], 1), (902, [None] + [1.0] * 11, 1), (903, [math.nan] * 12, 1),
           (904, [math.inf] + [0.0] * 11, 1), (905, [1.0] * 5, 2), (906, [1e30] * 12, 2)]
    got, ids, white = table(spark, rows + odd, 8, extra=True)
    want_ids, deviation, want, explained = brute(rows, 8)
    assert ids == want_ids and white.shape == (300, 8)
    assert np.allclose(signs(white, want), want, atol=1e-9)
    by = dict(zip(want_ids, deviation))
    assert all(r["deviation"] == by[r["vec_id"]] and r["n"] == 300 for r in got)
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_few_dimensions_of_variance_and_repeated_rows(spark):
    r = np.random.default_rng(2)
    flat = np.repeat(r.integers(-40, 40, (30, 3)), 2, axis=0)
    rows = [(i // 2, [float(a) / 64, float(b) / 64, float(c) / 64, 0.5, float(a + b) / 64], 0) for i, (a, b, c) in enumerate(flat)]
    got = whiten(frame(spark, rows), count=32).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and len(got) == 60 * 3
    assert got[0]["identity_error"] < 1e-9


def test_equal_eigenvalues(spark):
    rows = [(2 * k + s, [float((1 - 2 * s) * (k == j)) for j in range(6)], 0) for k in range(6) for s in (0, 1)]
    got = whiten(frame(spark, rows), count=6).collect()
    assert {r["component"] for r in got} == set(range(1, 7)) and got[0]["identity_error"] < 1e-9
    assert all(abs(r["explained"] - 1 / 6) < 1e-12 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.25, 0.5], 0)], [(1, [0.5], 0), (2, [0.5], 0)]])
def test_nothing_to_whiten(spark, rows):
    got = whiten(frame(spark, rows))
    assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]


def test_deviations_stay_exact_where_doubles_do_not():
    f = np.array([[2**40, -3], [5, 2**40 + 1]])
    sums = [2**40 + 5, 2**40 - 2]
    want = [sum((2 * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in f.tolist()]
    assert deviations(f, 2, sums) == [w if w < 2**63 else None for w in want]
    small = np.array([[1 << 20, 7], [3, 1]])
    assert deviations(small, 3, [5, 9]) == [sum((3 * int(e) - s) ** 2 for e, s in zip(r, [5, 9])) for r in small.tolist()]
