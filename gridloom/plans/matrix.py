"""A matrix as a DataFrame with a layout and a shape.

Layouts: ``wide`` (i, f0 .. f{n-1}), ``coo`` (i, j, v; every cell has a row) and ``vec`` (i, x array<double>). Rows are
named by an explicit key i. Everything but what says "action" is lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E

#: Cells that a matrix on the driver may have.
LOCAL_CELLS = 4_000_000
#: Columns up to which a matrix is worth one DataFrame column each.
WIDE_COLUMNS = 256


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    layout: str
    n: int
    rows: int | None = None

    # --- making one ---

    @staticmethod
    def from_wide(df: DataFrame, key: str, cols: Sequence[str], rows: int | None = None) -> Matrix:
        return Matrix(df.select(F.col(key).cast("long").alias("i"), *(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(cols))), "wide", len(cols), rows)

    @staticmethod
    def from_coo(df: DataFrame, n: int, rows: int | None = None, i: str = "i", j: str = "j", v: str = "v") -> Matrix:
        return Matrix(df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("int").alias("j"), F.col(v).cast("double").alias("v")), "coo", n, rows)

    @staticmethod
    def from_vec(df: DataFrame, key: str, col: str, n: int, rows: int | None = None) -> Matrix:
        return Matrix(df.select(F.col(key).cast("long").alias("i"), F.col(col).cast("array<double>").alias("x")), "vec", n, rows)

    @staticmethod
    def from_numpy(spark: SparkSession, a: np.ndarray) -> Matrix:
        a = np.atleast_2d(np.asarray(a, float))
        return Matrix(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, x array<double>"), "vec", a.shape[1], a.shape[0])

    @staticmethod
    def generate(spark: SparkSession, m: int, n: int, f: Callable[[Column], Column]) -> Matrix:
        """Cell (i, j) is f of its linear index i * n + j."""
        at = F.col("id")
        return Matrix(spark.range(m * n).select(F.floor(at / n).alias("i"), (at % n).cast("int").alias("j"), f(at).cast("double").alias("v")), "coo", n, m)

    # --- shape ---

    @property
    def m(self) -> int:
        """Rows; counting them is an action if they are not known."""
        if self.rows is None:
            df = self.df.select("i").distinct() if self.layout == "coo" else self.df
            object.__setattr__(self, "rows", df.count())
        return self.rows

    @property
    def dims(self) -> tuple[int, int]:
        return self.m, self.n

    @property
    def cols(self) -> list[str]:
        return [f"f{k}" for k in range(self.n)]

    @property
    def length(self) -> int:
        return self.m * self.n

    @property
    def size_bytes(self) -> int:
        return 8 * self.length

    @property
    def long_axis(self) -> int:
        return max(self.dims)

    @property
    def aspect(self) -> float:
        return self.m / self.n

    @property
    def is_square(self) -> bool:
        return self.m == self.n

    @property
    def is_row(self) -> bool:
        return self.m == 1

    @property
    def is_column(self) -> bool:
        return self.n == 1

    @property
    def is_vector(self) -> bool:
        return self.is_column or self.is_row

    @property
    def is_scalar(self) -> bool:
        return self.dims == (1, 1)

    @property
    def is_empty(self) -> bool:
        return self.n == 0 or self.m == 0

    def contains(self, i: int, j: int) -> bool:
        return 0 <= j < self.n and 0 <= i < self.m

    def can_multiply(self, other: Matrix) -> bool:
        return self.n == other.m

    def same_dims(self, other: Matrix) -> bool:
        return self.n == other.n and self.m == other.m

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.df.dtypes]

    # --- layouts ---

    def to_coo(self) -> Matrix:
        if self.layout == "coo":
            return self
        x = F.col("x") if self.layout == "vec" else F.array(*self.cols)
        return Matrix(self.df.select("i", F.posexplode(x).alias("j", "v")), "coo", self.n, self.rows)

    def to_vec(self) -> Matrix:
        if self.layout == "vec":
            return self
        if self.layout == "wide":
            return Matrix(self.df.select("i", F.array(*self.cols).alias("x")), "vec", self.n, self.rows)
        cells = F.array_sort(F.collect_list(F.struct("j", "v")))
        return Matrix(self.df.groupBy("i").agg(F.transform(cells, lambda s: s["v"]).alias("x")), "vec", self.n, self.rows)

    def to_wide(self) -> Matrix:
        if self.layout == "wide":
            return self
        if self.n > WIDE_COLUMNS:
            raise errors.BadDimensions(f"{self.n} columns are too many for the wide layout")
        if self.layout == "vec":
            return Matrix(self.df.select("i", *(F.get("x", F.lit(k)).alias(f"f{k}") for k in range(self.n))), "wide", self.n, self.rows)
        return Matrix(self.df.groupBy("i").agg(*(F.max(F.when(F.col("j") == k, F.col("v"))).alias(f"f{k}") for k in range(self.n))), "wide", self.n, self.rows)

    def to_local(self, most: int = LOCAL_CELLS) -> np.ndarray:
        """The values on the driver, rows by key (action); refused beyond ``most`` cells."""
        vec = self.to_vec().df
        got = vec.orderBy("i").limit(most // max(self.n, 1) + 1).collect()
        if len(got) * self.n > most:
            raise errors.TooLarge(f"more than {most} cells")
        return np.array([r["x"] for r in got], float).reshape(len(got), self.n)

    def persist(self) -> Matrix:
        return replace(self, df=self.df.persist())

    def release(self) -> None:
        self.df.unpersist()

    def show(self, rows: int = 20) -> None:
        self.to_vec().df.orderBy("i").show(rows, truncate=False)

    # --- elementwise ---

    def map(self, f: Callable[[Column], Column]) -> Matrix:
        if self.layout == "coo":
            df = self.df.withColumn("v", f(F.col("v")))
        elif self.layout == "vec":
            df = self.df.withColumn("x", F.transform("x", lambda v: f(v)))
        else:
            df = self.df.select("i", *(f(F.col(c)).alias(c) for c in self.cols))
        return replace(self, df=df)

    def map_indexed(self, f: Callable[[Column, Column, Column], Column]) -> Matrix:
        """f of (i, j, value)."""
        coo = self.to_coo()
        return replace(coo, df=coo.df.withColumn("v", f(F.col("i"), F.col("j"), F.col("v"))))

    def zip(self, other: Matrix, f: Callable[[Column, Column], Column]) -> Matrix:
        """f of the cells of both, joined by position."""
        if self.n != other.n or self.rows is not None and other.rows is not None and self.rows != other.rows:
            if self.rows is not None and other.rows is not None and self.is_vector and other.is_vector and self.length == other.length:
                return self._zip_vectors(other, f)
            raise errors.IncompatibleShapes(f"{self.rows}x{self.n} and {other.rows}x{other.n}")
        if self.layout == "wide" and other.layout == "wide":
            b = other.df.select("i", *(F.col(c).alias(f"g{k}") for k, c in enumerate(other.cols)))
            return replace(self, df=self.df.join(b, "i").select("i", *(f(F.col(c), F.col(f"g{k}")).alias(c) for k, c in enumerate(self.cols))))
        if "coo" not in (self.layout, other.layout):
            b = other.to_vec().df.withColumnRenamed("x", "y")
            return Matrix(self.to_vec().df.join(b, "i").select("i", F.zip_with("x", "y", lambda p, q: f(p, q)).alias("x")), "vec", self.n, self.rows)
        b = other.to_coo().df.withColumnRenamed("v", "w")
        return Matrix(self.to_coo().df.join(b, ["i", "j"]).select("i", "j", f(F.col("v"), F.col("w")).alias("v")), "coo", self.n, self.rows)

    def _zip_vectors(self, other: Matrix, f: Callable[[Column, Column], Column]) -> Matrix:
        at = lambda x: x.to_coo().df.select((F.col("i") * x.n + F.col("j")).alias("at"), "v")
        both = at(self).join(at(other).withColumnRenamed("v", "w"), "at")
        return Matrix(both.select(F.floor(F.col("at") / self.n).alias("i"), (F.col("at") % self.n).cast("int").alias("j"), f(F.col("v"), F.col("w")).alias("v")), "coo", self.n, self.rows)

    def _op(self, other: Matrix | float, two: Callable, one: Callable) -> Matrix:
        return self.zip(other, two) if isinstance(other, Matrix) else self.map(one(other))

    def __add__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.add, E.translate)

    __radd__ = __add__

    def __sub__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.sub, lambda k: E.translate(-k))

    def __rsub__(self, k: float) -> Matrix:
        return self.map(E.sub_from(k))

    def __mul__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.hadamard, E.scale)

    __rmul__ = __mul__

    def __truediv__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.divide, E.div_scalar)

    def __rtruediv__(self, k: float) -> Matrix:
        return self.map(E.scalar_div(k))

    def __pow__(self, e: float) -> Matrix:
        return self.map(E.power(e))

    def __neg__(self) -> Matrix:
        return self.map(E.negate)

    def __lt__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.smaller, E.less)

    def __gt__(self, o: Matrix | float) -> Matrix:
        return self._op(o, E.bigger, E.greater)

    def __le__(self, k: float) -> Matrix:
        return self.map(E.less_equal(k))

    def __ge__(self, k: float) -> Matrix:
        return self.map(E.greater_equal(k))

    def __and__(self, o: Matrix) -> Matrix:
        return self.zip(o, E.both)

    def __or__(self, o: Matrix) -> Matrix:
        return self.zip(o, E.either)

    def __matmul__(self, o: Matrix) -> Matrix:
        from gridloom.operators import linalg

        return linalg.product(self, o)

    @property
    def T(self) -> Matrix:  # noqa: N802
        from gridloom.operators import shape

        return shape.transpose(self)
