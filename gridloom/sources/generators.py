"""Generated matrices: each cell is an expression of its linear index over spark.range, so nothing is shipped from the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.operators import split
from gridloom.plans.matrix import Matrix


def constant(spark: SparkSession, m: int, n: int, c: float) -> Matrix:
    return Matrix.generate(spark, m, n, lambda at: E.num(c))


def zeros(spark: SparkSession, m: int, n: int) -> Matrix:
    return constant(spark, m, n, 0)


def ones(spark: SparkSession, m: int, n: int) -> Matrix:
    return constant(spark, m, n, 1)


def sequence(spark: SparkSession, m: int, n: int, start: float = 0, step: float = 1) -> Matrix:
    return Matrix.generate(spark, m, n, E.seq(start, step))


def sequence_mod(spark: SparkSession, m: int, n: int, phase: int, mod: int) -> Matrix:
    return Matrix.generate(spark, m, n, E.seq_mod(phase, mod))


def span(spark: SparkSession, m: int, n: int, start: float, end: float) -> Matrix:
    """m * n steps from start; end is not reached."""
    return Matrix.generate(spark, m, n, E.span(start, end, m * n))


def span_mod(spark: SparkSession, m: int, n: int, start: float, end: float, steps: int) -> Matrix:
    return Matrix.generate(spark, m, n, E.span_mod(start, end, steps))


def increasing_columns(spark: SparkSession, m: int, n: int, start: float = 0) -> Matrix:
    return Matrix.generate(spark, m, n, lambda at: E.num(start) + at % n)


def increasing_rows(spark: SparkSession, m: int, n: int, start: float = 0) -> Matrix:
    return Matrix.generate(spark, m, n, lambda at: E.num(start) + F.floor(at / n))


def evens(spark: SparkSession, m: int, n: int, phase: int = 0) -> Matrix:
    return Matrix.generate(spark, m, n, E.evens(phase))


def odds(spark: SparkSession, m: int, n: int, phase: int = 0) -> Matrix:
    return Matrix.generate(spark, m, n, E.odds(phase))


def sin(spark: SparkSession, m: int, n: int, amplitude: float = 1, phase: float = 0) -> Matrix:
    """amplitude * sin(c + phase), c the index counted down the columns; a period plays no part."""
    return Matrix.generate(spark, m, n, lambda at: E.num(amplitude) * F.sin((at % n) * m + F.floor(at / n) + E.num(phase)))


def sin_wave(spark: SparkSession, m: int, n: int, amplitude: float, period: float, phase: float = 0) -> Matrix:
    return Matrix.generate(spark, m, n, E.sin_wave(amplitude, period, phase))


def cos_wave(spark: SparkSession, m: int, n: int, amplitude: float, period: float, phase: float = 0) -> Matrix:
    return Matrix.generate(spark, m, n, E.cos_wave(amplitude, period, phase))


def diagonal(spark: SparkSession, dim: int, v: float) -> Matrix:
    return Matrix.generate(spark, dim, dim, lambda at: F.when(F.floor(at / dim) == at % dim, E.num(v)).otherwise(E.num(0)))


def identity(spark: SparkSession, dim: int) -> Matrix:
    return diagonal(spark, dim, 1)


def powers(spark: SparkSession, m: int, n: int, base: float) -> Matrix:
    return Matrix.generate(spark, m, n, E.powers(base))


def one_over_index(spark: SparkSession, m: int, n: int) -> Matrix:
    return Matrix.generate(spark, m, n, E.index_one_over)


def step_index(spark: SparkSession, m: int, n: int) -> Matrix:
    return Matrix.generate(spark, m, n, E.index_step)


def rand_sym(spark: SparkSession, m: int, n: int, eps: float = 1, seed: int = 1234) -> Matrix:
    """Uniform on (-eps, eps); the value follows from seed and index alone, so a lost task gives the same again."""
    u = lambda at: (split.integer_hash(split.integer_hash(at, seed), seed).cast("double") + 0.5) / float(split.PRIME)
    return Matrix.generate(spark, m, n, lambda at: (2 * u(at) - 1) * E.num(eps))


def rand_mod(spark: SparkSession, m: int, n: int, mod: int, eps: float, seed: int = 1234) -> Matrix:
    """Whole parts of rand_sym, the rest of dividing them by mod; the sign stays."""
    return rand_sym(spark, m, n, eps, seed).map(lambda v: (v.cast("long") % mod).cast("double"))


def from_scalar(spark: SparkSession, v: float) -> Matrix:
    return constant(spark, 1, 1, v)


def freeform(spark: SparkSession, cols: int, values: Sequence[float]) -> Matrix:
    if cols <= 0 or len(values) % cols:
        raise errors.BadDimensions(f"{len(values)} values in rows of {cols}")
    rows = [(k // cols, k % cols, float(v)) for k, v in enumerate(values)]
    return Matrix(spark.createDataFrame(rows, "i long, j int, v double"), "coo", cols, len(values) // cols)


def extrude(row: Matrix, depth: int) -> Matrix:
    """A row repeated ``depth`` more times."""
    if row.m != 1:
        raise errors.NotVector("a single row is needed")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth).cast("long")))
    return Matrix(row.to_coo().df.select(copies.alias("i"), "j", "v"), "coo", row.n, depth + 1)
