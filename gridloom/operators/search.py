"""Search by value and selection by index. Linear indices are i * n + j of the key i, so rows should be numbered from 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.plans.matrix import Matrix


def _at(x: Matrix) -> Column:
    return F.col("i") * x.n + F.col("j")


def find(x: Matrix, predicate: Callable[[Column], Column]) -> DataFrame:
    """Rows idx: linear indices of all cells for which the predicate (0 or 1) holds."""
    return x.to_coo().df.where(predicate(F.col("v")) != 0).select(_at(x).alias("idx"))


def find_first(x: Matrix, predicate: Callable[[Column], Column], n: int) -> DataFrame:
    """The n smallest of these; each task keeps n."""
    return find(x, predicate).orderBy("idx").limit(n)


def index_of(x: Matrix, value: float, eps: float = 1e-10) -> DataFrame:
    """One row (col, row): the first cell, by row, that is almost the value; (-1, -1) if none is."""
    hits = x.to_coo().df.where(E.almost_equal(value, eps)(F.col("v")) != 0)
    return hits.agg(F.min(F.struct("i", "j")).alias("p")).select(F.coalesce("p.j", F.lit(-1)).alias("col"), F.coalesce("p.i", F.lit(-1).cast("long")).alias("row"))


def index_in_row(x: Matrix, value: float, eps: float = 1e-10) -> int:
    """Place of the value in a single row; -1 if it is not there."""
    if x.m != 1:
        raise errors.NotVector("a single row is needed")
    return x.to_coo().df.where(E.almost_equal(value, eps)(F.col("v")) != 0).agg(F.coalesce(F.min("j"), F.lit(-1))).first()[0]


def argmax_rows(x: Matrix) -> DataFrame:
    """Rows (i, col): the column of each row's largest value, the first of equals."""
    if x.layout == "coo":
        return x.df.groupBy("i").agg(F.max(F.struct("v", (-F.col("j")).alias("back"))).alias("p")).select("i", (-F.col("p.back")).cast("int").alias("col"))
    return x.to_vec().df.select("i", (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("col"))


def row_indices(x: Matrix, row: int) -> range:
    if not 0 <= row < x.m:
        raise errors.OutOfBounds(f"row {row} of {x.m}")
    return range(row * x.n, (row + 1) * x.n)


def column_indices(x: Matrix, col: int) -> range:
    if not 0 <= col < x.n:
        raise errors.OutOfBounds(f"column {col} of {x.n}")
    return range(col, x.m * x.n, x.n)


def index_range(first: int, last: int) -> range:
    """Both ends are in."""
    return range(first, last + 1)


def columns(x: Matrix, take: Sequence[int]) -> Matrix:
    """The columns in this order; repeats are allowed."""
    if any(not 0 <= k < x.n for k in take):
        raise errors.OutOfBounds(f"columns {list(take)} of {x.n}")
    if x.layout == "wide":
        return Matrix(x.df.select("i", *(F.col(f"f{c}").alias(f"f{k}") for k, c in enumerate(take))), "wide", len(take), x.rows)
    if x.layout == "vec":
        return Matrix(x.df.select("i", F.array(*(F.get("x", F.lit(c)) for c in take)).alias("x")), "vec", len(take), x.rows)
    places: dict[int, list[int]] = {}
    for k, c in enumerate(take):
        places.setdefault(c, []).append(k)
    to = F.element_at(F.create_map(*(p for c, ks in places.items() for p in (F.lit(c), F.array(*map(F.lit, ks))))), F.col("j"))
    return Matrix(x.df.where(F.col("j").isin(list(places))).select("i", F.explode(to).alias("j"), "v"), "coo", len(take), x.rows)


def column(x: Matrix, col: int) -> Matrix:
    return columns(x, [col])


def row(x: Matrix, i: int) -> Matrix:
    return Matrix(x.df.where(F.col("i") == i).withColumn("i", F.lit(0).cast("long")), x.layout, x.n, 1)


def drop_first(x: Matrix) -> Matrix:
    return columns(x, range(1, x.n))


def drop_last(x: Matrix) -> Matrix:
    return columns(x, range(x.n - 1))


def gather(x: Matrix, index: DataFrame, rows: int | None = None) -> Matrix:
    """Rows by an index table (pos, i): row i becomes row pos. The join is on i, so a repeated i repeats its row."""
    got = x.df.join(index.select(F.col("pos").cast("long").alias("pos"), F.col("i").cast("long").alias("i")), "i").drop("i").withColumnRenamed("pos", "i")
    return Matrix(got.select("i", *[c for c in x.df.columns if c != "i"]), x.layout, x.n, rows)


def take_rows(x: Matrix, wanted: Sequence[int], cols: tuple[int, int] | None = None) -> Matrix:
    """Rows by a list, and of them the columns from cols[0] to cols[1] (the end is out)."""
    spark = x.df.sparkSession
    got = gather(x, spark.createDataFrame(list(enumerate(wanted)), "pos long, i long"), len(wanted))
    return got if cols is None else columns(got, range(*cols))


def copy_rows(target: Matrix, source: Matrix, pairs: Sequence[tuple[int, int]]) -> Matrix:
    """target with row t replaced by row s of source for each (t, s)."""
    if target.n != source.n:
        raise errors.IncompatibleShapes(f"{target.n} and {source.n} columns")
    moved = gather(source.to_vec(), target.df.sparkSession.createDataFrame(list(pairs), "pos long, i long"))
    a = target.to_vec()
    df = a.df.join(moved.df.withColumnRenamed("x", "y"), "i", "left").select("i", F.coalesce("y", "x").alias("x"))
    return Matrix(df, "vec", a.n, a.rows)


def submatrix(x: Matrix, rows: int, cols: int, row_at: int, col_at: int) -> Matrix:
    """The window of rows x cols at (row_at, col_at). Nothing is copied: a filter that reaches the scan, and a shift."""
    if not (0 <= col_at and col_at + cols <= x.n and 0 <= row_at) or x.rows is not None and row_at + rows > x.rows:
        raise errors.OutOfBounds(f"window {rows}x{cols} at ({row_at}, {col_at})")
    part = Matrix(x.df.where(F.col("i").between(row_at, row_at + rows - 1)).withColumn("i", F.col("i") - row_at), x.layout, x.n, rows)
    if x.layout == "coo":
        return Matrix(part.df.where(F.col("j").between(col_at, col_at + cols - 1)).withColumn("j", (F.col("j") - col_at).cast("int")), "coo", cols, rows)
    if x.layout == "vec":
        return Matrix(part.df.withColumn("x", F.slice("x", col_at + 1, cols)), "vec", cols, rows)
    return columns(part, range(col_at, col_at + cols))


def get(x: Matrix, i: int, j: int) -> float:
    """One cell (action)."""
    got = Matrix(x.df.where(F.col("i") == i), x.layout, x.n).to_coo().df.where(F.col("j") == j).first()
    if got is None:
        raise errors.OutOfBounds(f"({i}, {j})")
    return got["v"]


def get_linear(x: Matrix, at: int) -> float:
    return get(x, at // x.n, at % x.n)


def put(x: Matrix, i: int, j: int, v: float) -> Matrix:
    return x.map_indexed(lambda a, b, old: F.when((a == i) & (b == j), E.num(v)).otherwise(old))


def insertion_points(sorted_values: DataFrame, keys: DataFrame, value: str = "v", key: str = "key", eps: float = 0.0) -> DataFrame:
    """Rows (key, at) for values numbered from 0 in order: the place of the first value within eps of the key, or, where none is, the place at which the key would go in. Both are how many values are smaller than key - eps.

    One sort of values and keys together and a running count; no join by range. Partial counts go first, so the running count, which takes one task, goes over distinct values and keys.
    """
    marks = sorted_values.select(F.col(value).cast("double").alias("x"), F.lit(1).alias("own"), F.lit(None).cast("double").alias("k_")).union(keys.select((F.col(key).cast("double") - eps).alias("x"), F.lit(0).alias("own"), F.col(key).cast("double")))
    sums = marks.groupBy("x").agg(F.sum("own").alias("own"), F.count_if(F.col("own") == 0).alias("asked"), F.min("k_").alias("k_"))
    before = F.sum("own").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("at", F.coalesce(before, F.lit(0))).where("asked > 0")
    return placed.select(F.col("k_").alias(key), "at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked"))).alias("n_")).drop("n_")
