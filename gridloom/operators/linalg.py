"""Products and small dense linear algebra.

A product picks its strategy from the shapes: a factor that fits on the driver is shipped with the tasks and each row is
multiplied where it lies, without a shuffle; two large factors are joined block by block. Determinants and inverses are for small
matrices and run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.operators.reductions import SUM, expression
from gridloom.plans.matrix import LOCAL_CELLS, Matrix
from gridloom.plans.workspace import ship

#: Cells of a factor that is shipped to the tasks.
SHIP_CELLS = 1_000_000
#: Side of the blocks of a product of two large factors.
BLOCK = 512
#: Columns up to which X'X is one aggregate with a sum for each pair.
PAIR_COLUMNS = 16


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix product; a 1x1 factor scales."""
    if b.rows == 1 and b.n == 1 and a.n != 1:
        return a * b.to_coo().df.first()["v"]
    if a.rows == 1 and a.n == 1 and b.m != 1:
        return b * a.to_coo().df.first()["v"]
    if a.n != b.m:
        raise errors.IncompatibleShapes(f"{a.rows}x{a.n} times {b.m}x{b.n}")
    if b.length <= SHIP_CELLS:
        return product_local(a, b.to_local())
    if a.rows is not None and a.length <= SHIP_CELLS:
        from gridloom.operators.shape import transpose

        return transpose(product_local(transpose(b), a.to_local().T))
    return product_blocks(a, b)


def product_local(a: Matrix, b: np.ndarray) -> Matrix:
    """a times a matrix of the driver: each Arrow batch of rows is one dense product."""
    if a.n != b.shape[0]:
        raise errors.IncompatibleShapes(f"{a.n} columns times {b.shape}")
    ship(a.df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = t.column("x").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            y = x @ b
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([t.column("i"), flat], names=["i", "x"])

    return Matrix(a.to_vec().df.mapInArrow(run, "i long, x array<double>"), "vec", b.shape[1], a.rows)


def product_cells(a: Matrix, b: Matrix) -> Matrix:
    """The plain relational form: cells joined on the inner index, products summed by place."""
    left = a.to_coo().df.select("i", F.col("j").cast("long").alias("k"), F.col("v").alias("p"))
    right = b.to_coo().df.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
    df = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
    return Matrix(df.select("i", "j", "v"), "coo", b.n, a.rows)


def product_blocks(a: Matrix, b: Matrix, side: int = BLOCK) -> Matrix:
    """Blocks (i, k) of a go to every block column of b and blocks (k, j) of b to every block row of a; each (i, j, k) is a dense product in some task, summed by place. A block has side * side cells, whatever the matrices are, and the tasks are as many as the products of blocks, also where the inner side is short."""
    ship(a.df.sparkSession)
    down, across = -(-a.m // side), -(-b.n // side)
    cell = lambda df, i, j: df.select(i.cast("int").alias("bi"), j.cast("int").alias("bj"), F.struct((F.col("i") % side).cast("int").alias("r"), (F.col("j") % side).cast("int").alias("c"), "v").alias("s"))
    left = cell(a.to_coo().df, F.floor(F.col("i") / side), F.floor(F.col("j") / side)).groupBy("bi", "bj").agg(F.collect_list("s").alias("a"))
    right = cell(b.to_coo().df, F.floor(F.col("i") / side), F.floor(F.col("j") / side)).groupBy("bi", "bj").agg(F.collect_list("s").alias("b"))
    left = left.select(F.col("bi").alias("i"), F.col("bj").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), "a")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), F.col("bi").alias("k"), F.col("bj").alias("j"), "b")
    pairs = left.join(right, ["i", "j", "k"]).select("i", "j", "a", "b")

    def dense(s: pa.StructScalar) -> np.ndarray:
        cells = s.values
        out = np.zeros((side, side))
        out[cells.field("r").to_numpy(), cells.field("c").to_numpy()] = cells.field("v").to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                y = dense(t.column("a")[k]) @ dense(t.column("b")[k])
                r, c = np.nonzero(np.ones_like(y))
                yield pa.RecordBatch.from_arrays([pa.array(r + side * t.column("i")[k].as_py(), pa.int64()), pa.array(c + side * t.column("j")[k].as_py(), pa.int32()), pa.array(y.ravel())], names=["i", "j", "v"])

    cells = pairs.mapInArrow(run, "i long, j int, v double")
    done = cells.where((F.col("i") < a.m) & (F.col("j") < b.n)).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return Matrix(done.select("i", "j", "v"), "coo", b.n, a.rows)


def _fits(n: int) -> None:
    """An n x n result must fit on the driver and in each task; beyond, ``product_blocks`` of the transpose and x is the way."""
    if n * n > LOCAL_CELLS:
        raise errors.TooLarge(f"{n} x {n} cells")


def gram(x: Matrix) -> np.ndarray:
    """X'X on the driver (action): one aggregate with a sum for each pair of few columns, else partial products of batches, summed by place. One pass, no join. Refused where X'X would not fit on the driver."""
    n = x.n
    _fits(n)
    if n <= PAIR_COLUMNS:
        wide = x.to_wide()
        row = wide.df.agg(*(F.coalesce(F.sum(F.col(f"f{a}") * F.col(f"f{b}")), E.num(0)).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n))).first()
        out = np.zeros((n, n))
        for a in range(n):
            for b in range(a, n):
                out[a, b] = out[b, a] = row[f"g{a}_{b}"]
        return out
    ship(x.df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((n, n))
        for t in batches:
            rows = t.column("x").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            g += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(g.ravel())], names=["at", "v"])

    cells = x.to_vec().df.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n * n)
    for r in cells:
        out[r["at"]] = r["v"]
    return out.reshape(n, n)


def center(x: Matrix, mu: list[float]) -> Matrix:
    wide = x.to_wide()
    return Matrix(wide.df.select("i", *((F.col(c) - E.num(mu[k])).alias(c) for k, c in enumerate(wide.cols))), "wide", x.n, x.rows)


def sqr_center(x: Matrix, mu: list[float]) -> Matrix:
    return center(x, mu).map(E.sqr)


def normalize(x: Matrix) -> Matrix:
    """(X - column means) / s with one s for all cells: the root of the summed squares over m n - 1 (one action for the statistics)."""
    wide = x.to_wide()
    stats = wide.df.agg(F.count("*").alias("m"), *(F.avg(c).alias(c) for c in wide.cols), *(F.var_pop(c).alias(f"var_{c}") for c in wide.cols)).first()
    s = (sum(stats[f"var_{c}"] for c in wide.cols) * stats["m"] / (stats["m"] * x.n - 1)) ** 0.5
    return center(x, [stats[c] for c in wide.cols]) / s


def z_scores(x: Matrix) -> Matrix:
    """Each column by its own mean and deviation; a constant column becomes 0."""
    wide = x.to_wide()
    stats = wide.df.agg(*(F.avg(c).alias(c) for c in wide.cols), *(F.stddev_pop(c).alias(f"sd_{c}") for c in wide.cols)).first()
    cols = [(((F.col(c) - E.num(stats[c])) / E.num(stats[f"sd_{c}"])) if stats[f"sd_{c}"] else E.num(0)).alias(c) for c in wide.cols]
    return Matrix(wide.df.select("i", *cols), "wide", x.n, x.rows)


def covariance(x: Matrix) -> np.ndarray:
    """The population covariance on the driver: one pass for few columns, else one for the means and one for partial products of centred rows (actions)."""
    _fits(x.n)
    if x.n > PAIR_COLUMNS:
        coo = x.to_coo().df.groupBy("j").agg(F.avg("v").alias("mu"), F.count("*").alias("m")).collect()
        mu, m = np.zeros(x.n), max((r["m"] for r in coo), default=0)
        for r in coo:
            mu[r["j"]] = r["mu"]
        centred = x.to_vec().df.select("i", F.zip_with("x", F.array(*map(E.num, mu)), lambda a, b: a - b).alias("x"))
        return gram(Matrix(centred, "vec", x.n, x.rows)) / m
    wide = x.to_wide()
    pairs = [(a, b) for a in range(x.n) for b in range(a, x.n)]
    row = wide.df.agg(*(F.covar_pop(f"f{a}", f"f{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    out = np.zeros((x.n, x.n))
    for a, b in pairs:
        out[a, b] = out[b, a] = row[f"c{a}_{b}"]
    return out


def principal_components(x: Matrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest variances and their directions (columns), from one pass over the data."""
    values, vectors = np.linalg.eigh(covariance(x))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def trace_product(x: Matrix) -> float:
    return x.df.agg(expression(x, SUM, E.sqr)).first()[0]


# --- on the driver ---


def _square(a: np.ndarray) -> np.ndarray:
    a = np.array(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise errors.NotSquare(f"{a.shape}")
    return a


class LU:
    """Factors P A = L U by columns, the largest element of each as pivot. The input is copied."""

    def __init__(self, a: np.ndarray) -> None:
        self.u = _square(a)
        n = len(self.u)
        self.order, self.sign = np.arange(n), 1.0
        for k in range(n):
            p = k + int(np.argmax(np.abs(self.u[k:, k])))
            if p != k:
                self.u[[k, p]], self.order[[k, p]], self.sign = self.u[[p, k]], self.order[[p, k]], -self.sign
            if self.u[k, k]:
                self.u[k + 1 :, k] /= self.u[k, k]
                self.u[k + 1 :, k + 1 :] -= np.outer(self.u[k + 1 :, k], self.u[k, k + 1 :])

    @property
    def is_singular(self) -> bool:
        return bool((np.abs(np.diag(self.u)) < 1e-6).any())

    @property
    def det(self) -> float:
        return float(self.sign * np.prod(np.diag(self.u)))

    def solve(self, b: np.ndarray) -> np.ndarray:
        if self.is_singular:
            raise errors.SingularMatrix("no unique solution")
        x = np.array(b, float)[self.order]
        for k in range(len(x)):
            x[k] -= self.u[k, :k] @ x[:k]
        for k in reversed(range(len(x))):
            x[k] = (x[k] - self.u[k, k + 1 :] @ x[k + 1 :]) / self.u[k, k]
        return x


def minor_matrix(a: np.ndarray, i: int, j: int) -> np.ndarray:
    """a without row i and column j."""
    return np.delete(np.delete(_square(a), i, 0), j, 1)


def minor(a: np.ndarray, i: int, j: int) -> float:
    return determinant(minor_matrix(a, i, j))


def sign_at(i: int, j: int) -> int:
    return -1 if (i + j) % 2 else 1


def cofactor(a: np.ndarray, i: int, j: int) -> float:
    return sign_at(i, j) * minor(a, i, j)


def cofactor_matrix(a: np.ndarray) -> np.ndarray:
    a = _square(a)
    return np.array([[cofactor(a, i, j) for j in range(len(a))] for i in range(len(a))])


def determinant(a: np.ndarray) -> float:
    a = _square(a)
    return LU(a).det if len(a) else 1.0


def inverse(a: np.ndarray, det: float | None = None) -> np.ndarray:
    """The inverse; with a known determinant by cofactors."""
    a = _square(a)
    if det is not None:
        if det == 0:
            raise errors.SingularMatrix("determinant 0")
        return cofactor_matrix(a).T / det
    return LU(a).solve(np.eye(len(a)))


def diagonal_covariance(variances: np.ndarray) -> np.ndarray:
    return np.diag(np.ravel(variances))


def determinant_3x3(x: Matrix) -> DataFrame:
    """One row det, without the driver: the closed form over the cells of a 3x3 matrix."""
    if x.n != 3:
        raise errors.NotSquare("three columns are needed")
    c = {(i, j): F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))) for i in range(3) for j in range(3)}
    det = c[0, 0] * (c[1, 1] * c[2, 2] - c[1, 2] * c[2, 1]) - c[0, 1] * (c[1, 0] * c[2, 2] - c[1, 2] * c[2, 0]) + c[0, 2] * (c[1, 0] * c[2, 1] - c[1, 1] * c[2, 0])
    return x.to_coo().df.agg(det.alias("det"))
