"""Reductions of whole matrices, rows and columns. Any number of them goes into one aggregate, that is one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.plans.matrix import Matrix


@dataclass(frozen=True)
class Monoid:
    """An associative operation: as an aggregate, for two values, and its identity (the result for no values)."""

    total: Callable[[Column], Column]
    two: Callable[[Column, Column], Column]
    unit: float

    def of(self, c: Column) -> Column:
        return F.coalesce(self.total(c), E.num(self.unit))


_INF = float("inf")
SUM = Monoid(F.sum, lambda a, b: a + b, 0)
PROD = Monoid(F.product, lambda a, b: a * b, 1)
MIN = Monoid(F.min, lambda a, b: F.least(a, b), _INF)
MAX = Monoid(F.max, lambda a, b: F.greatest(a, b), -_INF)
AND = Monoid(lambda c: F.min(E.truth(c != 0)), E.both, 1)
OR = Monoid(lambda c: F.max(E.truth(c != 0)), E.either, 0)
MIN_NOT_ZERO = Monoid(lambda c: F.min(F.nullif(c, F.lit(0.0))), E.min_not_zero, 0)


def expression(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity) -> Column:
    """An aggregate over x.df that reduces f of all its cells. Wide: one aggregate a column, then combined; vec: a fold in each row first."""
    if x.layout == "coo":
        return monoid.of(f(F.col("v")))
    if x.layout == "wide":
        return fold(monoid.two, [monoid.of(f(F.col(c))) for c in x.cols])
    return monoid.of(F.aggregate(F.transform("x", lambda v: f(v)), E.num(monoid.unit), monoid.two))


def reduce_many(x: Matrix, **specs: tuple) -> DataFrame:
    """One row with a column for each name=(monoid,) or name=(monoid, f)."""
    return x.df.agg(*(expression(x, *spec).alias(name) for name, spec in specs.items()))


def reduce(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity) -> float:
    """The reduced value (action)."""
    return reduce_many(x, v=(monoid, f)).first()[0]


def total(x: Matrix) -> float:
    return reduce(x, SUM)


def exact_sum(x: Matrix) -> float:
    """The sum in decimals of 18 places: the same in any order."""
    return float(x.to_coo().df.agg(F.coalesce(F.sum(F.col("v").cast("decimal(38,18)")), F.lit(0))).first()[0])


def bounds(x: Matrix) -> tuple[float, float]:
    r = reduce_many(x, low=(MIN,), high=(MAX,)).first()
    return r["low"], r["high"]


def auto_dot(x: Matrix) -> float:
    return reduce(x, SUM, E.sqr)


def vector_length(x: Matrix) -> float:
    if not x.is_vector:
        raise errors.NotVector("a length is that of a vector")
    return auto_dot(x) ** 0.5


def norm_expression(x: Matrix, order: int) -> Column:
    """Order 1: sum of absolute values; else the root of the sum of powers, signs kept."""
    if order == 1:
        return expression(x, SUM, F.abs)
    return F.pow(expression(x, SUM, E.int_power(order)), E.num(1 / order))


# --- truth ---


def truths_of(x: Matrix, predicates: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row with a struct for each predicate (0 or 1): all, any, none (boolean) and count (long) of the cells for which it holds. No cells: true, false, true, 0. One pass for all of them."""

    def of(f: Callable[[Column], Column]) -> Column:
        some = expression(x, OR, f)
        return F.struct((expression(x, AND, f) != 0).alias("all"), (some != 0).alias("any"), (some == 0).alias("none"), expression(x, SUM, lambda v: E.truth(f(v) != 0)).cast("long").alias("count"))

    return x.df.agg(*(of(f).alias(name) for name, f in predicates.items()))


def truths(x: Matrix, predicate: Callable[[Column], Column]) -> DataFrame:
    """One row: all, any, none and count of one predicate."""
    return truths_of(x, {"p": predicate}).select("p.*")


def all_of(x: Matrix, predicate: Callable[[Column], Column]) -> bool:
    return truths(x, predicate).first()["all"]


def any_of(x: Matrix, predicate: Callable[[Column], Column]) -> bool:
    return truths(x, predicate).first()["any"]


def none_of(x: Matrix, predicate: Callable[[Column], Column]) -> bool:
    return truths(x, predicate).first()["none"]


def count_of(x: Matrix, predicate: Callable[[Column], Column]) -> int:
    return truths(x, predicate).first()["count"]


def is_zero(x: Matrix, eps: float = 1e-10) -> bool:
    return all_of(x, E.almost_equal(0, eps))


def is_biased(x: Matrix, eps: float = 1e-10) -> bool:
    """Whether column 0 is all ones."""
    return reduce_columns(x, AND, E.almost_equal(1, eps), only=[0]).first()["f0"] != 0


def is_binary(x: Matrix) -> bool:
    return all_of(x, E.one_or_zero)


# --- by column ---


def column_expressions(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity, only: list[int] | None = None) -> list[Column]:
    """An aggregate for each column of a wide matrix."""
    return [monoid.of(f(F.col(f"f{k}"))).alias(f"f{k}") for k in (range(x.n) if only is None else only)]


def reduce_columns(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity, only: list[int] | None = None) -> DataFrame:
    """One row, a value for each column. A wide matrix takes one aggregate; others go by (j) and then into a row."""
    if any(not 0 <= k < x.n for k in only or ()):
        raise errors.OutOfBounds(f"columns {only} of {x.n}")
    if x.layout == "wide" or x.layout == "vec" and x.n <= 64:
        wide = x.to_wide()
        return wide.df.agg(*column_expressions(wide, monoid, f, only))
    coo = x.to_coo().df.where(F.col("j").isin(only)) if only is not None else x.to_coo().df
    cells = coo.groupBy("j").agg(monoid.of(f(F.col("v"))).alias("v"))
    return cells.agg(*(F.coalesce(F.max(F.when(F.col("j") == k, F.col("v"))), E.num(monoid.unit)).alias(f"f{k}") for k in (range(x.n) if only is None else only)))


def by_column(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity) -> DataFrame:
    """Rows (j, v); the form for many columns."""
    return x.to_coo().df.groupBy("j").agg(monoid.of(f(F.col("v"))).alias("v"))


def column_sum(x: Matrix, col: int) -> float:
    return reduce_columns(x, SUM, only=[col]).first()[0]


def means(x: Matrix) -> DataFrame:
    """One row: the mean of each column."""
    wide = x.to_wide()
    return wide.df.agg(*(F.avg(c).alias(c) for c in wide.cols))


def variances(x: Matrix, mu: list[float] | None = None) -> DataFrame:
    """One row: the population variance of each column, about given means if there are any."""
    wide = x.to_wide()
    return wide.df.agg(*(F.var_pop(c).alias(c) if mu is None else F.avg(E.sqr(F.col(c) - E.num(mu[k]))).alias(c) for k, c in enumerate(wide.cols)))


def fit_gaussians(x: Matrix) -> DataFrame:
    """One row: mu_k and var_k of each column, in one pass."""
    wide = x.to_wide()
    return wide.df.agg(*(F.avg(c).alias(f"mu_{k}") for k, c in enumerate(wide.cols)), *(F.var_pop(c).alias(f"var_{k}") for k, c in enumerate(wide.cols)))


# --- by row ---


def by_row(x: Matrix, monoid: Monoid, f: Callable[[Column], Column] = E.identity) -> DataFrame:
    """Rows (i, v), for any number of columns; wide and vec need no shuffle."""
    if x.layout == "coo":
        return x.df.groupBy("i").agg(monoid.of(f(F.col("v"))).alias("v"))
    if x.layout == "wide":
        return x.df.select("i", fold(monoid.two, [f(F.col(c)) for c in x.cols], E.num(monoid.unit)).alias("v"))
    return x.df.select("i", F.aggregate(F.transform("x", lambda v: f(v)), E.num(monoid.unit), monoid.two).alias("v"))


def row_sums(x: Matrix) -> DataFrame:
    return by_row(x, SUM)


def reduce_row(x: Matrix, row: int, monoid: Monoid) -> float:
    got = by_row(Matrix(x.df.where(F.col("i") == row), x.layout, x.n), monoid).first()
    if got is None:
        raise errors.OutOfBounds(f"no row {row}")
    return got["v"]


# --- by index ---


def indexed(x: Matrix, where: Callable[[Column, Column], Column], monoid: Monoid) -> Column:
    """An aggregate over x.to_coo().df of the cells whose (i, j) pass; with a filter in front Spark prunes before it."""
    return monoid.of(F.when(where(F.col("i"), F.col("j")), F.col("v")))


def reduce_indexed(x: Matrix, where: Callable[[Column, Column], Column], monoid: Monoid) -> DataFrame:
    """One row v: the reduced cells whose position passes."""
    return x.to_coo().df.where(where(F.col("i"), F.col("j"))).agg(monoid.of(F.col("v")).alias("v"))


def reduce_index(spark, count: int, f: Callable[[Column], Column], monoid: Monoid) -> DataFrame:
    """One row v: f of the indices 0 .. count-1, reduced."""
    return spark.range(count).agg(monoid.of(f(F.col("id")).cast("double")).alias("v"))


def factorial(spark, n: int) -> float:
    return reduce_index(spark, n, lambda at: at + 1, PROD).first()[0]


def triangular(n: int) -> int:
    """1 + 2 + .. + n."""
    return n * (n + 1) // 2


def biggest_bin(counts: DataFrame, index: str = "idx", count: str = "cnt") -> DataFrame:
    """One row: the index of the largest count, the first of equals."""
    return counts.agg(F.max(F.struct(F.col(count), (-F.col(index)).alias("back"))).alias("m")).select((-F.col("m.back")).alias(index))


# --- of two matrices ---


def combine(a: Matrix, b: Matrix, f: Callable[[Column, Column], Column], monoid: Monoid) -> DataFrame:
    """One row v: f of cells at the same place, reduced."""
    both = a.zip(b, f)
    return both.df.agg(expression(both, monoid).alias("v"))


def sum_sqr_diff(a: Matrix, b: Matrix) -> float:
    return combine(a, b, E.diff_sqr, SUM).first()[0]


def accuracy(a: Matrix, b: Matrix) -> float:
    """Equal cells by rows (for columns the share that is equal)."""
    return combine(a, b, E.equals, SUM).first()[0] / a.m


def same(a: Matrix, b: Matrix) -> bool:
    """Equal shape and exactly equal cells; two empty matrices are the same."""
    if a.is_empty and b.is_empty:
        return True
    return a.same_dims(b) and combine(a, b, E.equals, AND).first()[0] != 0


def almost_same(a: Matrix, b: Matrix, eps: float = 1e-10) -> bool:
    return a.same_dims(b) and combine(a, b, E.almost(eps), AND).first()[0] != 0


def dot(a: Matrix, b: Matrix) -> float:
    return combine(a, b, E.hadamard, SUM).first()[0]
