import math

import numpy as np
import pytest

from gridloom.llm import whitening as wh


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<double>, n int, Whitened double").repartition(3)


def brute(vectors, most=8):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[n * r[k] - s[k] for k in range(d)] for r in x], object)
    c = y.astype(float) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    return n, [int(r) for r in (y * y).sum(axis=1)], values[:most], (c @ u[:, :most]) / np.sqrt(values[:most]), values[:most] / values.sum()


def compare(got, vectors, most=8):
    n, deviation, values, white, explained = brute(vectors, most)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == n * len(values)
    for k in range(len(values)):
        mine = np.array([by[i, k + 1]["whitened"] for i in range(n)])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine, sign * white[:, k], atol=1e-8)
        for i in range(n):
            r = by[i, k + 1]
            assert r["n"] == n and int(r["deviation"]) == deviation[i]
            assert abs(r["explained"] - explained[k]) < 1e-12 and 0 <= r["identity_error"] < 1e-9


@pytest.mark.parametrize("decay", [1.0, 0.4])
def test_against_brute_force(table, decay):
    """A flat spectrum makes the block grow to the full dimension, a steep one is settled by the passes."""
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 40)) * decay ** np.arange(40) * 50).tolist()
    compare(wh.whitened(table(list(enumerate(vectors)))).collect(), vectors)
    found = wh.Vectors.of(table(list(enumerate(vectors))), "vec_id", "embedding")
    assert wh.components(found)[3] == (decay == 1.0)


def test_few_dimensions_and_repeated_rows(table):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((50, 3)).tolist()
    compare(wh.whitened(table(list(enumerate(vectors)))).collect(), vectors)
    twice = wh.whitened(table([(5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), (None, [3.0, 5.0])])).collect()
    assert len(twice) == 8 and {r["n"] for r in twice} == {4} and sum(r["vec_id"] is None for r in twice) == 2
    assert wh.whitened(table([(5, [0.0, 1.0]), (6, [1.0, 0.0])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rows_that_are_left_out(table):
    good = [(k, [float(k % 3), float(k % 5), float(k)]) for k in range(20)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 1.0, 2.0]), (94, []), (95, [1.0, 2.0]), (96, [1.0, None, 1.0, 1.0, 1.0])]
    compare(wh.whitened(table(good + bad)).collect(), [v for _, v in good])


def test_no_variance_and_no_rows(table):
    assert wh.whitened(table([(1, [1.0, 2.0])])).count() == 0
    assert wh.whitened(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert wh.whitened(table([])).count() == wh.whitened(table([(1, None)])).count() == 0
    line = wh.whitened(table([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_whole_numbers_beyond_64_bits(table):
    vectors = [[k * 1e12, float(k % 7), -k * 3e11 + k % 4] for k in range(40)]
    got = {r["vec_id"]: int(r["deviation"]) for r in wh.whitened(table(list(enumerate(vectors)))).collect()}
    assert [got[k] for k in range(40)] == brute(vectors, 1)[1] and max(got.values()) > 2**63
    with pytest.raises(Exception, match="too large"):
        wh.whitened(table([(1, [1e300]), (2, [0.0])])).count()


def test_exact_sums_of_squares():
    rng = np.random.default_rng(3)
    for high in (2**20, 2**45, 2**61):
        y = rng.integers(-high, high, (50, 30))
        assert wh.deviations(y) == [sum(int(v) ** 2 for v in r) for r in y]
