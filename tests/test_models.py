from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.operators import anomaly, descent, kmeans, linalg, neural, numbers, reductions, regression
from gridloom.plans.matrix import Matrix


def test_minimise_quadratic_and_valley():
    a = np.array([[3.0, 1], [1, 2]])
    x, costs, _ = descent.minimise(lambda t: (float(t @ a @ t / 2 - t.sum()), a @ t - 1), np.zeros(2))
    assert np.allclose(x, np.linalg.solve(a, np.ones(2)), atol=1e-4)
    valley = lambda t: (float(100 * (t[1] - t[0] ** 2) ** 2 + (1 - t[0]) ** 2), np.array([-400 * t[0] * (t[1] - t[0] ** 2) - 2 * (1 - t[0]), 200 * (t[1] - t[0] ** 2)]))
    x, costs, _ = descent.minimise(valley, np.array([-1.2, 1.0]), 200)
    assert np.allclose(x, 1, atol=1e-2) and all(b <= a for a, b in zip(costs, costs[1:], strict=False))


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), float(1 + 2 * a - b), int(a + b > 0.3)) for a, b in x]
    return spark.createDataFrame(rows, "a double, b double, y double, c int").persist()


def test_linear(line):
    d = regression.design(line, ["a", "b"], "y")
    assert np.allclose(regression.linear_solve(d, 3), [1, 2, -1])
    assert np.allclose(regression.linear_descent(d, np.zeros(3), 0.3, 200), [1, 2, -1], atol=1e-6)
    cost, grad = regression.linear_cost_grad(d, np.array([1.0, 2, -1]))
    assert cost < 1e-20 and np.allclose(grad, 0)


def test_logistic(line):
    d = regression.design(line, ["a", "b"], "c")
    assert regression.logistic_cost_grad(d, np.zeros(3))[0] == pytest.approx(np.log(2))
    t = np.array([0.3, -0.5, 1.0])
    want = descent.numeric_gradients(lambda ts: regression.logistic_costs(d, ts, 2.0), t)
    assert np.allclose(regression.logistic_cost_grad(d, t, 2.0)[1], want, atol=1e-6)
    theta, costs = regression.logistic_fit(d, 3, 0.01, 15)
    assert costs[-1] < 0.2 and costs == sorted(costs, reverse=True)
    p = regression.logistic_predict(d, theta)
    assert regression.accuracy(p).first()[0] > 95 and regression.misclassified(p).first()[0] < 10


def test_network_gradients_and_training(spark):
    rows = [([float(np.sin(k * 3 + j)) / 10 for j in range(3)], (k + 1) % 3 + 1) for k in range(5)]
    data = spark.createDataFrame(rows, "x array<double>, y int").coalesce(1)
    layers = neural.sin_weights([3, 5, 3])
    assert neural.gradient_check(data, [w[:, :] for w in layers], 3.0) < 1e-3
    deep = neural.init([3, 4, 4, 3])
    c, g = neural.cost_grad(data, deep, 1.0)
    w = [x.copy() for x in deep]
    w[1][2, 1] += 1e-4
    up = neural.cost(data, w, 1.0)
    w[1][2, 1] -= 2e-4
    assert g[1][2, 1] == pytest.approx((up - neural.cost(data, w, 1.0)) / 2e-4, abs=1e-5)
    _, costs = neural.train(data, layers, 0.01, 5)
    assert costs[-1] < costs[0]
    assert neural.predict(data, layers).count() == 5
    assert len(neural.topologies(3, [[4, 5], [6, 7, 8]], 2, len)) == 6


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    m = Matrix.from_numpy(spark, x)
    c, steps = kmeans.fit(m, np.array([[1.0, 1], [4, 4], [1, 4]]))
    assert np.allclose(c, [[0, 0], [5, 5], [0, 5]], atol=0.2) and steps < 10
    far = np.array([[0.0, 0], [99, 99]])
    assert (kmeans.update(kmeans.assign(m, far), far)[1] == 99).all()  # no members: it stays


def test_densities(spark):
    rng = np.random.default_rng(5)
    x = rng.normal([3, -1], [1, 2], (50, 2))
    m = Matrix.from_numpy(spark, x)
    mu, var = x.mean(0), x.var(0)
    want = np.prod([np.exp(-((x[:, k] - mu[k]) ** 2) / (2 * var[k])) / np.sqrt(2 * np.pi * var[k]) for k in (0, 1)], 0)
    by_i = lambda df, c: np.array([r[c] for r in df.orderBy("i").collect()])
    assert np.allclose(by_i(anomaly.row_densities(m), "p"), want)
    assert np.allclose(by_i(anomaly.product_of(anomaly.feature_densities(m)), "p"), want)
    assert np.allclose(np.exp(by_i(anomaly.row_log_densities(m), "logp")), want)
    assert np.allclose(by_i(anomaly.multivariate(m, mu, var), "p"), want)
    assert anomaly.density_of(1, 1, 4) == pytest.approx(1 / np.sqrt(8 * np.pi))
    assert np.allclose(anomaly.sigma_vector(m).first(), 0, atol=1e-12)


def test_threshold_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p, y = rng.random(300), rng.random(300) < 0.2
    p[y] *= 0.4
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    step = (p.max() - p.min()) / 50
    best = (0.0, -1.0)
    for k in range(1, 51):
        told = p < p.min() + k * step
        tp = (told & y).sum()
        f1 = 2 * tp / (told.sum() + y.sum())
        if f1 > best[1]:
            best = (p.min() + k * step, f1)
    got = anomaly.select_threshold(df, 50).first()
    assert got["eps"] == pytest.approx(best[0]) and got["f1"] == pytest.approx(best[1])
    assert anomaly.select_threshold(df.limit(0), 5).first()["f1"] is None


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3)) * [3, 1, 0.1]
    values, _ = linalg.principal_components(Matrix.from_numpy(spark, x), 3)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    wide = rng.normal(5, 1, (40, 20))
    assert np.allclose(linalg.covariance(Matrix.from_numpy(spark, wide)), np.cov(wide.T, bias=True))


def test_factors_of_large_values(spark):
    df = spark.createDataFrame([(104729,), (2**20,), (104729 * 2,), (99991 * 99989,), (97 * 101,)], "v long")
    got = {r["v"]: (r["smallest_factor"], r["largest_factor"], r["is_prime"]) for r in numbers.prime_factors(df, "v").collect()}
    assert got[104729] == (104729, 104729, True) and got[2**20] == (2, 2, False) and got[104729 * 2] == (2, 104729, False) and got[97 * 101] == (97, 101, False)
    assert got[99991 * 99989][2] is None or got[99991 * 99989][2] is False


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (4.0,)], "x double")
    x = F.col("x")
    rows = df.select(E.log(x), E.one_over(x), E.divide(E.num(1), x), E.inv_sqrt(x), E.sigmoid_series(30)(x), E.sigmoid(x)).collect()
    assert rows[0][0] == -np.inf and np.isnan(rows[1][0]) and rows[0][1] == 0 and rows[0][2] == np.inf
    assert rows[0][3] == np.inf and rows[2][3] == 0.5 and all(abs(r[4] - r[5]) < 1e-6 for r in rows)


def test_means_given_index(spark):
    assert reductions.triangular(100) == 5050
    assert reductions.reduce_index(spark, 10, lambda at: at, reductions.MAX).first()[0] == 9
