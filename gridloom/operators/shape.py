"""Shape and layout. In the cell layout most of these only rename indices, which costs nothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.plans.matrix import Matrix


def _cells(df: DataFrame, i, j, v, n: int, m: int | None) -> Matrix:
    return Matrix(df.select(i.cast("long").alias("i"), j.cast("int").alias("j"), v.alias("v")), "coo", n, m)


def transpose(x: Matrix) -> Matrix:
    return _cells(x.to_coo().df, F.col("j"), F.col("i"), F.col("v"), x.m, x.n)


def reshape(x: Matrix, rows: int, cols: int, offset: int = 0) -> Matrix:
    """rows * cols cells from linear index offset on, in linear order."""
    if offset < 0 or x.rows is not None and offset + rows * cols > x.length:
        raise errors.OutOfBounds(f"{rows}x{cols} at {offset}")
    at = F.col("i") * x.n + F.col("j") - offset
    df = x.to_coo().df.where(at.between(0, rows * cols - 1))
    return _cells(df, F.floor(at / cols), at % cols, F.col("v"), cols, rows)


def as_row(x: Matrix) -> Matrix:
    return reshape(x, 1, x.length)


def as_column(x: Matrix) -> Matrix:
    return reshape(x, x.length, 1)


def to_scalar(x: Matrix) -> float:
    if not x.is_scalar:
        raise errors.BadDimensions(f"{x.dims} is no scalar")
    return x.to_coo().df.first()["v"]


def diagonal_of(x: Matrix) -> Matrix:
    """The diagonal as a column."""
    if not x.is_square:
        raise errors.NotSquare(f"{x.dims}")
    return _cells(x.to_coo().df.where("i = j"), F.col("i"), F.lit(0), F.col("v"), 1, x.n)


def diagonal_from(x: Matrix) -> Matrix:
    """A vector as the diagonal of a matrix that is else 0."""
    if not x.is_vector:
        raise errors.NotVector(f"{x.dims}")
    k = x.length
    at = F.col("i") + F.col("j")
    row = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(c == at, F.col("v")).otherwise(E.num(0)))
    return Matrix(x.to_coo().df.select(at.cast("long").alias("i"), row.alias("x")), "vec", k, k)


def right(a: Matrix, b: Matrix) -> Matrix:
    """The columns of both."""
    if a.rows is not None and b.rows is not None and a.rows != b.rows:
        raise errors.IncompatibleShapes(f"{a.rows} and {b.rows} rows")
    if "coo" in (a.layout, b.layout):
        tail = b.to_coo().df.withColumn("j", (F.col("j") + a.n).cast("int"))
        return Matrix(a.to_coo().df.union(tail.select("i", "j", "v")), "coo", a.n + b.n, a.rows)
    if a.layout == b.layout == "wide":
        moved = b.df.select("i", *(F.col(c).alias(f"f{a.n + k}") for k, c in enumerate(b.cols)))
        return Matrix(a.df.join(moved, "i"), "wide", a.n + b.n, a.rows)
    df = a.to_vec().df.join(b.to_vec().df.withColumnRenamed("x", "y"), "i").select("i", F.concat("x", "y").alias("x"))
    return Matrix(df, "vec", a.n + b.n, a.rows)


def below(a: Matrix, b: Matrix) -> Matrix:
    """The rows of both."""
    if a.n != b.n:
        raise errors.IncompatibleShapes(f"{a.n} and {b.n} columns")
    b = b.to_wide() if a.layout == "wide" else b.to_vec() if a.layout == "vec" else b.to_coo()
    return Matrix(a.df.unionByName(b.df.withColumn("i", F.col("i") + a.m)), a.layout, a.n, None if b.rows is None else a.m + b.rows)


def concat(parts: Sequence[Matrix]) -> Matrix:
    """All cells of all parts as one row."""
    at, dfs = 0, []
    for x in parts:
        dfs.append(x.to_coo().df.select(F.lit(0).cast("long").alias("i"), (F.col("i") * x.n + F.col("j") + at).cast("int").alias("j"), "v"))
        at += x.length
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return Matrix(out, "coo", at, 1)


def unconcat(x: Matrix, rows: int, cols: int, offset: int) -> Matrix:
    return reshape(x, rows, cols, offset)


def pack(layers: Sequence[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Driver-side matrices as one vector, and their shapes."""
    return np.concatenate([np.asarray(a, float).ravel() for a in layers]), [a.shape for a in layers]


def unpack(packed: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in shapes])
    return [p.reshape(s) for p, s in zip(np.split(packed, ends[:-1]), shapes, strict=True)]


def bias(x: Matrix) -> Matrix:
    """A column of ones in front."""
    if x.layout == "wide":
        return Matrix(x.df.select("i", E.num(1).alias("f0"), *(F.col(c).alias(f"f{k + 1}") for k, c in enumerate(x.cols))), "wide", x.n + 1, x.rows)
    return Matrix(x.to_vec().df.select("i", F.concat(F.array(E.num(1)), "x").alias("x")), "vec", x.n + 1, x.rows)


def tile(x: Matrix, down: int, across: int) -> Matrix:
    """The matrix repeated; each cell is multiplied in its own row, without a join."""
    if down < 1 or across < 1:
        raise errors.BadDimensions("no copies")
    m, n = x.dims
    copies = x.to_coo().df.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return _cells(copies, F.col("i") + F.col("a") * m, F.col("j") + F.col("b") * n, F.col("v"), n * across, m * down)


def overlay(target: Matrix, source: Matrix, row_at: int, col_at: int) -> Matrix:
    """target with source written over it at (row_at, col_at)."""
    if row_at < 0 or col_at < 0 or row_at + source.m > target.m or col_at + source.n > target.n:
        raise errors.OutOfBounds(f"{source.dims} at ({row_at}, {col_at}) of {target.dims}")
    over = source.to_coo().df.select((F.col("i") + row_at).alias("i"), (F.col("j") + col_at).cast("int").alias("j"), F.col("v").alias("w"))
    return Matrix(target.to_coo().df.join(over, ["i", "j"], "left").select("i", "j", F.coalesce("w", "v").alias("v")), "coo", target.n, target.rows)


def one_hot(x: Matrix) -> Matrix:
    """A label column as 0/1 columns, one for each distinct label (action). Labels count from 1 if none is 0, else from 0."""
    if not x.is_column:
        raise errors.NotVector("a label column is needed")
    coo = x.to_coo().df
    seen = coo.agg(F.count_distinct("v").alias("n"), F.coalesce(F.min("v"), E.num(0)).alias("low")).first()
    first = 0 if seen["low"] == 0 else 1
    if seen["n"] > 10_000:
        raise errors.TooLarge(f"{seen['n']} labels")
    row = F.transform(F.sequence(F.lit(first), F.lit(first + seen["n"] - 1)), lambda c: E.truth(F.col("v") == c))
    return Matrix(coo.select("i", row.alias("x")), "vec", seen["n"], x.rows)


def poly_features(x: Matrix, degree: int) -> Matrix:
    """Of two columns a and b: 1, then a^(p-q) b^q for p = 1 .. degree and q = 0 .. p (28 columns for degree 6)."""
    if x.n != 2:
        raise errors.BadDimensions("two columns are needed")
    a, b = F.col("f0"), F.col("f1")
    terms = [E.num(1)] + [E.int_power(p - q)(a) * E.int_power(q)(b) for p in range(1, degree + 1) for q in range(p + 1)]
    return Matrix(x.to_wide().df.select("i", *(t.alias(f"f{k}") for k, t in enumerate(terms))), "wide", len(terms), x.rows)
