"""k-means: assignment, update, distortion and the loop. Centroids live on the driver and go with the tasks; a batch of rows is
one dense product with them, and only sums by cluster leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.matrix import Matrix
from gridloom.plans.workspace import ship

#: Rows that meet the centroids at a time.
_ROWS = 2000


def _rows(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid, the first of equals, and the squared distance to it. A product of the centred values ranks the centroids; those that are equal but for rounding are held against each other exactly."""
    shift = centroids.mean(0)
    near, c = x - shift, centroids - shift
    length, most = (near * near).sum(1), (c * c).sum(1)
    d = length[:, None] - 2 * (near @ c.T) + most
    slack = 1e-12 * (length + most.max())
    close = d <= (d.min(1) + slack)[:, None]
    best = close.argmax(1)
    for r in np.flatnonzero(close.sum(1) > 1):
        ks = np.flatnonzero(close[r])
        best[r] = ks[((x[r] - centroids[ks]) ** 2).sum(1).argmin()]
    return best, ((x - centroids[best]) ** 2).sum(1)


def assign(x: Matrix, centroids: np.ndarray) -> DataFrame:
    """Rows (i, x, cluster, dist2): the nearest centroid, the first of equals."""
    ship(x.df.sparkSession)
    centroids = np.asarray(centroids, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                t = batch.slice(at, _ROWS)
                best, d = nearest(_rows(t.column("x")), centroids)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(best, pa.int32()), pa.array(d)], names=["i", "x", "cluster", "dist2"])

    return x.to_vec().df.mapInArrow(run, "i long, x array<double>, cluster int, dist2 double")


def update(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the members (action); a cluster without members keeps its centroid. A task leaves one row a cluster."""
    ship(assigned.sparkSession)
    k, n = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, n + 1))
        for t in batches:
            if t.num_rows:
                rows, cluster = _rows(t.column("x")), t.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                ids, first = np.unique(cluster[order], return_index=True)
                sums[ids, :n] += np.add.reduceat(rows[order], first)
                sums[ids, n] += np.diff([*first, len(order)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["cluster", "sums"])

    parts = assigned.select("x", "cluster").mapInArrow(run, "cluster int, sums array<double>")
    cells = parts.select("cluster", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((k, n + 1))
    for r in cells.collect():
        out[r["cluster"], r["at"]] = r["v"]
    held = out[:, n] > 0
    new = np.array(centroids, float)
    new[held] = out[held, :n] / out[held, n:]
    return new


def distortion(assigned: DataFrame) -> DataFrame:
    """One row: the mean squared distance."""
    return assigned.agg(F.avg("dist2").alias("distortion"))


def fit(x: Matrix, centroids: np.ndarray, eps: float = 1e-9, most: int = 100) -> tuple[np.ndarray, int]:
    """Steps until the centroids move by no more than eps in all, or ``most`` of them (one action each)."""
    x = x.to_vec().persist()
    for step in range(1, most + 1):
        new = update(assign(x, centroids), centroids)
        moved = float(((new - centroids) ** 2).sum())
        centroids = new
        if moved <= eps:
            break
    x.release()
    return centroids, step
