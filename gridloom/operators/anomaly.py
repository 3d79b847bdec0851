"""Gaussian densities and the threshold that tells anomalies best."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.operators import linalg
from gridloom.operators.reductions import fit_gaussians
from gridloom.plans.matrix import Matrix

_ROOT = 1 / math.sqrt(2 * math.pi)


def density(x: Column, mu: Column, var: Column) -> Column:
    return E.num(_ROOT) / F.sqrt(var) * F.exp(-(x - mu) * (x - mu) / (2 * var))


def density_of(x: float, mu: float, var: float) -> float:
    return _ROOT / math.sqrt(var) * math.exp(-((x - mu) ** 2) / (2 * var))


def _fitted(x: Matrix, fit: DataFrame | None) -> DataFrame:
    """Rows of x beside the one row of statistics: a broadcast of 2 n numbers."""
    wide = x.to_wide()
    return wide.df.join(F.broadcast(fit_gaussians(wide) if fit is None else fit), how="cross")


def feature_densities(x: Matrix, fit: DataFrame | None = None) -> Matrix:
    """Density of each cell under its column's Gaussian (fitted on x, or as given by a row of mu_k and var_k)."""
    rows = _fitted(x, fit)
    return Matrix(rows.select("i", *(density(F.col(f"f{k}"), F.col(f"mu_{k}"), F.col(f"var_{k}")).alias(f"f{k}") for k in range(x.n))), "wide", x.n, x.rows)


def row_densities(x: Matrix, fit: DataFrame | None = None) -> DataFrame:
    """Rows (i, p): the product of the cells' densities."""
    f = feature_densities(x, fit)
    out = E.num(1)
    for c in f.cols:
        out = out * F.col(c)
    return f.df.select("i", out.alias("p"))


def row_log_densities(x: Matrix, fit: DataFrame | None = None, keep: tuple[str, ...] = ("i",)) -> DataFrame:
    """Rows (i, logp), or with the columns keep of a wide matrix's table: the sum of logarithms, which does not vanish for many columns."""
    rows = _fitted(x, fit)
    terms = [-(F.col(f"f{k}") - F.col(f"mu_{k}")) * (F.col(f"f{k}") - F.col(f"mu_{k}")) / (2 * F.col(f"var_{k}")) - F.log(F.col(f"var_{k}")) / 2 for k in range(x.n)]
    return rows.select(*keep, (sum(terms[1:], terms[0]) + E.num(x.n * math.log(_ROOT))).alias("logp"))


def product_of(features: Matrix) -> DataFrame:
    """Rows (i, p) from densities made before."""
    out = E.num(1)
    for c in features.to_wide().cols:
        out = out * F.col(c)
    return features.to_wide().df.select("i", out.alias("p"))


def multivariate(x: Matrix, mu: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """Rows (i, p): the density of N(mu, sigma); a vector sigma is a diagonal. Inverse and determinant are small and become literals."""
    sigma = np.asarray(sigma, float)
    sigma = linalg.diagonal_covariance(sigma) if sigma.ndim == 1 or 1 in sigma.shape and sigma.size > 1 else sigma
    lu = linalg.LU(sigma)
    inv = lu.solve(np.eye(len(sigma)))
    wide = linalg.center(x, list(map(float, mu)))
    form = E.num(0)
    for a in range(x.n):
        inner = E.num(0)
        for b in range(x.n):
            if inv[a, b]:
                inner = inner + F.col(f"f{b}") * E.num(inv[a, b])
        form = form + F.col(f"f{a}") * inner
    return wide.df.select("i", (E.num((2 * math.pi) ** (-x.n / 2) * lu.det**-0.5) * F.exp(-form / 2)).alias("p"))


def sigma_vector(x: Matrix) -> DataFrame:
    """One row: the column means of the normalised matrix."""
    from gridloom.operators.reductions import means

    return means(linalg.normalize(x))


def threshold_scores(scores: DataFrame, steps: int = 1000, p: str = "p", y: str = "y") -> DataFrame:
    """Rows (step, eps, tp, fp, fn, f1): thresholds in equal steps from just over the least score to the largest; a row is told
    anomalous if p < eps; y is 1 for an anomaly. f1 is null where nothing was told right or wrong.

    The scores are not paired with the thresholds: each score falls into the first step that tells it, counts by step are one
    aggregate, and running sums over the (at most steps) counts give every threshold at once.
    """
    s = scores.select(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y")).where("p IS NOT NULL AND NOT isnan(p)")
    ends = s.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos"))
    spark = scores.sparkSession
    grid = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("step")).join(F.broadcast(ends), how="cross")
    step_size = (F.col("high") - F.col("low")) / E.num(steps)
    eps = F.col("low") + F.col("step") * step_size
    # the first step whose threshold is over p; nudged by the exact comparison against rounding of the division
    guess = F.greatest(F.floor((F.col("p") - F.col("low")) / F.nullif(step_size, F.lit(0.0))), F.lit(1)).cast("int")
    low_ok = lambda k: F.col("p") < F.col("low") + k * step_size
    told = s.join(F.broadcast(ends), how="cross").withColumn("k", F.coalesce(guess, F.lit(steps + 1)))
    told = told.withColumn("k", F.when((F.col("k") > 1) & low_ok(F.col("k") - 1), F.col("k") - 1).when(low_ok(F.col("k")), F.col("k")).when(low_ok(F.col("k") + 1), F.col("k") + 1).otherwise(F.col("k") + 2))
    counts = told.groupBy("k").agg(F.sum("y").alias("hit"), F.sum(1 - F.col("y")).alias("miss")).withColumnRenamed("k", "step")
    from pyspark.sql import Window

    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.join(counts, "step", "left").select("step", eps.alias("eps"), "pos", F.sum(F.coalesce("hit", F.lit(0))).over(upto).alias("tp"), F.sum(F.coalesce("miss", F.lit(0))).over(upto).alias("fp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")
    return sums.select("step", "eps", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), (2.0 * tp / F.nullif((2 * tp + fp + fn).cast("double"), F.lit(0.0))).alias("f1"))


def select_threshold(scores: DataFrame, steps: int = 1000, p: str = "p", y: str = "y") -> DataFrame:
    """One row (eps, f1): the best threshold, the least of equals."""
    return threshold_scores(scores, steps, p, y).where("f1 IS NOT NULL").agg(F.max(F.struct("f1", (-F.col("eps")).alias("back"))).alias("b")).select((-F.col("b.back")).alias("eps"), F.col("b.f1").alias("f1"))
