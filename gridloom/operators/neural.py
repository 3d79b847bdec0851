"""Feed-forward networks of sigmoid layers. Weights are small and live on the driver; rows are taken batch by batch as dense
products, and only sums of gradients leave the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product as combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import descent
from gridloom.operators.shape import pack, unpack
from gridloom.plans.workspace import ship

Layers = list[np.ndarray]


def init(sizes: Sequence[int], seed: int = 1) -> Layers:
    """Weights (outputs, inputs + 1), the first column the bias, uniform within sqrt(6 / (in + out))."""
    rng = np.random.default_rng(seed)
    return [rng.uniform(-1, 1, (b, a + 1)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]


def sin_weights(sizes: Sequence[int]) -> Layers:
    """sin(1), sin(2), ... / 10 down the columns: the same everywhere."""
    return [np.sin(np.arange(1, b * (a + 1) + 1)).reshape(a + 1, b).T / 10 for a, b in zip(sizes, sizes[1:])]


@dataclass
class Passed:
    """What a forward pass leaves: z and a of each layer; the last a is the hypothesis."""

    z: list[np.ndarray]
    a: list[np.ndarray]

    @property
    def hypothesis(self) -> np.ndarray:
        return self.a[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def forward(layers: Layers, x: np.ndarray) -> Passed:
    out = Passed([], [x])
    for w in layers:
        z = out.a[-1] @ w[:, 1:].T + w[:, 0]
        out.z.append(z)
        out.a.append(_sigmoid(z))
    return out


def back(layers: Layers, passed: Passed, y: np.ndarray) -> Layers:
    """Gradients of the summed cross-entropy of one-hot y, layer by layer."""
    out: Layers = []
    delta = passed.hypothesis - y
    for k in range(len(layers) - 1, -1, -1):
        a = passed.a[k]
        out.append(np.concatenate((delta.sum(0)[:, None], delta.T @ a), 1))
        if k:
            delta = (delta @ layers[k][:, 1:]) * a * (1 - a)
    return out[::-1]


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Summed cross-entropy from the last layer's z."""
    return float((np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))).sum())


def penalty(layers: Layers, lam: float, m: int) -> tuple[float, Layers]:
    free = [np.concatenate((np.zeros((len(w), 1)), w[:, 1:]), 1) for w in layers]
    return lam / (2 * m) * float(sum((f * f).sum() for f in free)), [lam / m * f for f in free]


def _rows(t: pa.RecordBatch) -> np.ndarray:
    return t.column("x").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def cost_grad(data: DataFrame, layers: Layers, lam: float = 0.0, first_label: int = 1, gradient: bool = True) -> tuple[float, Layers]:
    """Cost and gradients over data(x array<double>, y: label counted from first_label); one pass, one small aggregate (action)."""
    ship(data.sparkSession)
    shapes, classes = [w.shape for w in layers], len(layers[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grads, m = 0.0, [np.zeros(s) for s in shapes], 0
        for t in batches:
            if not t.num_rows:
                continue
            y = np.eye(classes)[t.column("y").to_numpy().astype(int) - first_label]
            passed = forward(layers, _rows(t))
            total, m = total + loss(passed.z[-1], y), m + t.num_rows
            if gradient:
                grads = [g + h for g, h in zip(grads, back(layers, passed, y), strict=True)]
        flat = np.concatenate(([total, m], *(g.ravel() for g in grads)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["at", "v"])

    sums = data.select("x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + sum(a * b for a, b in shapes))
    for r in sums:
        flat[r["at"]] = r["v"]
    m = max(int(flat[1]), 1)
    extra, more = penalty(layers, lam, m)
    return flat[0] / m + extra, [g / m + h for g, h in zip(unpack(flat[2:], shapes), more, strict=True)]


def cost(data: DataFrame, layers: Layers, lam: float = 0.0, first_label: int = 1) -> float:
    return cost_grad(data, layers, lam, first_label, gradient=False)[0]


def packed_cost(data: DataFrame, shapes: Sequence[tuple[int, int]], lam: float = 0.0, first_label: int = 1) -> descent.Cost:
    """Cost and gradient of packed weights, for ``descent.minimise``."""

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        c, grads = cost_grad(data, unpack(theta, shapes), lam, first_label)
        return c, pack(grads)[0]

    return f


def train(data: DataFrame, layers: Layers, lam: float = 0.0, iterations: int = 50, first_label: int = 1) -> tuple[Layers, list[float]]:
    data = data.select("x", "y").persist()
    theta, shapes = pack(layers)
    theta, costs, _ = descent.minimise(packed_cost(data, shapes, lam, first_label), theta, iterations)
    data.unpersist()
    return unpack(theta, shapes), costs


def activations(data: DataFrame, layers: Layers) -> DataFrame:
    """data (with x array<double>) and h, the output activations of each row."""
    ship(data.sparkSession)
    names = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            h = forward(layers, _rows(t)).hypothesis
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32)), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([*t.columns, flat], names=[*names, "h"])

    return data.mapInArrow(run, data.withColumn("h", F.lit(None).cast("array<double>")).schema)


def predict(data: DataFrame, layers: Layers, first_label: int = 1) -> DataFrame:
    """activations and label, the place of the largest one."""
    h = activations(data, layers)
    return h.withColumn("label", (F.array_position("h", F.array_max("h")) - 1 + first_label).cast("int"))


def gradient_check(data: DataFrame, layers: Layers, lam: float = 0.0, h: float = 1e-4) -> float:
    """The largest gap between the gradients and central differences; for tiny networks."""
    theta, shapes = pack(layers)
    f = packed_cost(data, shapes, lam)
    return float(np.abs(f(theta)[1] - descent.numeric_gradient(lambda t: cost(data, unpack(t, shapes), lam), theta, h)).max())


def topologies(inputs: int, hidden: Sequence[Sequence[int]], outputs: int, f: Callable[[list[int]], object]) -> list[tuple[list[int], object]]:
    """f of the layer sizes, for every choice of hidden sizes."""
    return [([inputs, *h, outputs], f([inputs, *h, outputs])) for h in combinations(*hidden)]
