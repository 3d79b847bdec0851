"""Linear and logistic regression. X is wide with a bias column f0; the target is a column y of the same DataFrame, so no join is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.operators import descent


def design(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Columns f0 (ones), f1.. and y."""
    return df.select(E.num(1).alias("f0"), *(F.col(c).cast("double").alias(f"f{k + 1}") for k, c in enumerate(features)), F.col(target).cast("double").alias("y"))


def _predicted(theta: np.ndarray) -> Column:
    out = F.col("f0") * E.num(theta[0])
    for k in range(1, len(theta)):
        out = out + F.col(f"f{k}") * E.num(theta[k])
    return out


def _penalty(theta: np.ndarray, lam: float, m: float) -> tuple[float, np.ndarray]:
    free = np.concatenate(([0.0], theta[1:]))
    return lam / (2 * m) * float(free @ free), lam * free / m


def linear_sums(theta: np.ndarray) -> list[Column]:
    """Aggregates: m, sse, and g_k, the sum of residual times feature."""
    r = _predicted(theta) - F.col("y")
    return [F.count("*").alias("m"), F.sum(r * r).alias("sse"), *(F.sum(r * F.col(f"f{k}")).alias(f"g{k}") for k in range(len(theta)))]


def linear_cost_grad(data: DataFrame, theta: np.ndarray, lam: float = 0.0) -> tuple[float, np.ndarray]:
    """Half the mean squared residual and its gradient, the bias free of the penalty (one action)."""
    row = data.agg(*linear_sums(theta)).first()
    m = row["m"]
    cost, grad = _penalty(theta, lam, m)
    return row["sse"] / (2 * m) + cost, np.array([row[f"g{k}"] for k in range(len(theta))]) / m + grad


def normal_sums(data: DataFrame, n: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """m, X'X, X'y and y'y in one pass."""
    names = [*(f"f{k}" for k in range(n)), "y"]
    pairs = [(a, b) for a in range(n + 1) for b in range(a, n + 1)]
    row = data.agg(F.count("*").alias("m"), *(F.sum(F.col(names[a]) * F.col(names[b])).alias(f"s{a}_{b}") for a, b in pairs)).first()
    s = np.zeros((n + 1, n + 1))
    for a, b in pairs:
        s[a, b] = s[b, a] = row[f"s{a}_{b}"]
    return row["m"], s[:n, :n], s[:n, n], s[n, n]


def linear_descent(data: DataFrame, theta: np.ndarray, alpha: float, iterations: int, lam: float = 0.0) -> np.ndarray:
    """Batch gradient descent. The data is read once: the gradient follows from X'X and X'y, so the steps run on the driver."""
    m, xx, xy, _ = normal_sums(data, len(theta))
    for _ in range(iterations):
        theta = theta - alpha * ((xx @ theta - xy) / m + _penalty(theta, lam, m)[1])
    return theta


def linear_solve(data: DataFrame, n: int, lam: float = 0.0) -> np.ndarray:
    """The exact minimum of the linear cost."""
    m, xx, xy, _ = normal_sums(data, n)
    return np.linalg.solve(xx + lam * np.diag([0.0] + [1.0] * (n - 1)), xy)


def _log_loss(z: Column, y: Column) -> Column:
    """-y ln s(z) - (1 - y) ln(1 - s(z)), without overflow: max(z, 0) - y z + ln(1 + exp(-|z|))."""
    return F.greatest(z, E.num(0)) - y * z + F.log1p(F.exp(-F.abs(z)))


def logistic_sums(theta: np.ndarray) -> list[Column]:
    z = _predicted(theta)
    r = E.sigmoid(z) - F.col("y")
    return [F.count("*").alias("m"), F.sum(_log_loss(z, F.col("y"))).alias("loss"), *(F.sum(r * F.col(f"f{k}")).alias(f"g{k}") for k in range(len(theta)))]


def logistic_cost_grad(data: DataFrame, theta: np.ndarray, lam: float = 0.0) -> tuple[float, np.ndarray]:
    """Mean cross-entropy and its gradient (one action)."""
    row = data.agg(*logistic_sums(theta)).first()
    m = row["m"]
    cost, grad = _penalty(theta, lam, m)
    return row["loss"] / m + cost, np.array([row[f"g{k}"] for k in range(len(theta))]) / m + grad


def logistic_costs(data: DataFrame, thetas: list[np.ndarray], lam: float = 0.0) -> list[float]:
    """The cost at many points in one pass."""
    row = data.agg(F.count("*").alias("m"), *(F.sum(_log_loss(_predicted(t), F.col("y"))).alias(f"c{k}") for k, t in enumerate(thetas))).first()
    return [row[f"c{k}"] / row["m"] + _penalty(t, lam, row["m"])[0] for k, t in enumerate(thetas)]


def logistic_cost_classes(data: DataFrame, thetas: np.ndarray, labels: list[float], lam: float = 0.0) -> float:
    """One model a class (a row of thetas each): the summed cost with y as one-hot."""
    loss = [F.sum(_log_loss(_predicted(t), E.truth(F.col("y") == label))).alias(f"c{k}") for k, (t, label) in enumerate(zip(thetas, labels, strict=True))]
    row = data.agg(F.count("*").alias("m"), *loss).first()
    return sum(row[f"c{k}"] for k in range(len(labels))) / row["m"] + sum(_penalty(t, lam, row["m"])[0] for t in thetas)


def logistic_fit(data: DataFrame, n: int, lam: float = 0.0, iterations: int = 50) -> tuple[np.ndarray, list[float]]:
    data = data.persist()
    theta, costs, _ = descent.minimise(lambda t: logistic_cost_grad(data, t, lam), np.zeros(n), iterations)
    data.unpersist()
    return theta, costs


def logistic_predict(data: DataFrame, theta: np.ndarray) -> DataFrame:
    """data with h, the probability of 1."""
    return data.withColumn("h", E.sigmoid(_predicted(theta)))


def misclassified(predicted: DataFrame) -> DataFrame:
    """One row: how many rows h tells wrongly."""
    return predicted.agg(F.sum(E.misclassified(F.col("h"), F.col("y"))).cast("long").alias("wrong"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: per cent of rows that h, cut at one half, tells rightly."""
    return predicted.agg((100 * F.avg(E.truth(E.truth(F.col("h") >= 0.5) == F.col("y")))).alias("accuracy"))
