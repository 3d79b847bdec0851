"""Scalar functions of one value, two values or a linear index, as Column builders.

Every builder takes Columns and returns one, so chains of them fuse into a single generated stage. Truth values are 0.0 and
1.0. IEEE rules hold where Spark's own functions give NULL or an error: log(0) is -inf, 1/0 is inf.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]

#: Gap below which two values are almost equal, by element type; integers compare exactly.
EPSILON = {"float": 1e-6, "double": 1e-10, "int": 0.0, "bigint": 0.0}
_INF, _NAN = float("inf"), float("nan")


def num(x: float) -> Column:
    return F.lit(float(x))


def truth(cond: Column) -> Column:
    return cond.cast("double")


def divide(a: Column, b: Column) -> Column:
    """IEEE quotient."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, num(_INF)).when(a < 0, num(-_INF)).when(a.isNotNull() & b.isNotNull(), num(_NAN))


# --- one value ---


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_grad(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def softplus(x: Column) -> Column:
    """ln(1 + exp(-x)); the sign of x is part of the definition."""
    return F.log1p(F.exp(-x))


def deg2(x: Column) -> Column:
    return -(x * x) - 2 * x + 11.5


def poly2(x: Column) -> Column:
    return x * x - 2 * x - 11.5


def negate(x: Column) -> Column:
    return -x


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, num(-_INF)).when(x < 0, num(_NAN))


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def one_over(x: Column) -> Column:
    """1/x, and 0 for 0."""
    return F.when(x == 0, num(0)).otherwise(1 / F.nullif(x, F.lit(0.0)))


def sqr(x: Column) -> Column:
    return x * x


def cube(x: Column) -> Column:
    return x * x * x


def inv_sqrt(x: Column) -> Column:
    return divide(num(1), F.sqrt(x))


def one_or_zero(x: Column) -> Column:
    return truth((x == 0) | (x == 1))


def identity(x: Column) -> Column:
    return x


def sigmoid_series(depth: int) -> Unary:
    """The sigmoid with exp(-x) cut off after ``depth`` powers."""
    return lambda x: 1 / (1 + sum((F.pow(-x, num(k)) / float(math.factorial(k)) for k in range(1, depth + 1)), num(1)))


def power(e: float) -> Unary:
    return lambda x: F.pow(x, num(e))


def int_power(e: int) -> Unary:
    """x to a whole exponent by repeated squaring."""

    def f(x: Column) -> Column:
        out, base, left = num(1), x, abs(e)
        while left:
            if left & 1:
                out = out * base
            base, left = base * base, left >> 1
        return out if e >= 0 else divide(num(1), out)

    return f


def scale(k: float) -> Unary:
    return lambda x: x * num(k)


def translate(k: float) -> Unary:
    return lambda x: x + num(k)


def sub_from(k: float) -> Unary:
    return lambda x: num(k) - x


def div_scalar(k: float) -> Unary:
    """x * (1/k): the last bit may differ from x / k."""
    return lambda x: x * num(1 / k)


def scalar_div(k: float) -> Unary:
    """k / x, and 0 for 0."""
    return lambda x: one_over(x) * num(k)


def divisible(d: float) -> Unary:
    """x where it divides d without rest, else 0."""
    return lambda x: F.when((x != 0) & (num(d) % F.nullif(x, F.lit(0.0)) == 0), x).otherwise(num(0))


def divides_both(d1: float, d2: float) -> Unary:
    return lambda x: F.when((x != 0) & (num(d1) % F.nullif(x, F.lit(0.0)) == 0) & (num(d2) % F.nullif(x, F.lit(0.0)) == 0), x).otherwise(num(0))


def div_sqrt(d: float) -> Unary:
    return lambda x: F.sqrt(x / num(d))


def less(k: float) -> Unary:
    return lambda x: truth(x < num(k))


def less_equal(k: float) -> Unary:
    return lambda x: truth(x <= num(k))


def greater(k: float) -> Unary:
    return lambda x: truth(x > num(k))


def greater_equal(k: float) -> Unary:
    return lambda x: truth(x >= num(k))


def equal(k: float) -> Unary:
    return lambda x: truth(x == num(k))


def not_equal(k: float) -> Unary:
    return lambda x: truth(x != num(k))


def almost_equal(k: float, eps: float = 1e-10) -> Unary:
    return lambda x: truth(F.abs(x - num(k)) < num(eps))


def not_almost_equal(k: float, eps: float = 1e-10) -> Unary:
    """A gap of exactly eps is neither almost equal nor not."""
    return lambda x: truth(F.abs(x - num(k)) > num(eps))


def index_where_almost(k: float, eps: float = 1e-10) -> Binary:
    """Takes (linear index, value): the index where the value is almost k, else 0."""
    return lambda at, x: F.when(F.abs(x - num(k)) < num(eps), at).otherwise(F.lit(0))


UNARY: dict[str, Unary] = {"sigmoid": sigmoid, "sigmoid_grad": sigmoid_grad, "softplus": softplus, "deg2": deg2, "poly2": poly2, "negate": negate, "log": log, "floor": floor, "ceil": ceil, "abs": F.abs, "one_over": one_over, "exp": F.exp, "sqrt": F.sqrt, "sqr": sqr, "cube": cube, "inv_sqrt": inv_sqrt, "one_or_zero": one_or_zero, "sign": F.signum}


# --- two values ---


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def hadamard(a: Column, b: Column) -> Column:
    return a * b


def both(a: Column, b: Column) -> Column:
    return truth((a != 0) & (b != 0))


def either(a: Column, b: Column) -> Column:
    return truth((a != 0) | (b != 0))


def equals(a: Column, b: Column) -> Column:
    return truth(a == b)


def almost(eps: float = 1e-10) -> Binary:
    return lambda a, b: truth(F.abs(b - a) < num(eps))


def diff_sqr(a: Column, b: Column) -> Column:
    return (b - a) * (b - a)


def misclassified(a: Column, b: Column) -> Column:
    """a is a score, b a label of 0 or 1."""
    return truth(((a >= 0.5) & (b == 0)) | ((a < 0.5) & (b == 1)))


def divides(a: Column, b: Column) -> Column:
    """b where it divides a without rest, else 0."""
    return F.when((b != 0) & (a % F.nullif(b, F.lit(0.0)) == 0), b).otherwise(num(0))


def sqr_plus(a: Column, b: Column) -> Column:
    """a squared plus b squared. Not associative, so no reduction takes it."""
    return a * a + b * b


def min_not_zero(a: Column, b: Column) -> Column:
    """The smaller, but of a zero and another value the other."""
    return F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))


def bigger(a: Column, b: Column) -> Column:
    return truth(a > b)


def smaller(a: Column, b: Column) -> Column:
    return truth(a < b)


def linterp(k: float) -> Binary:
    return lambda a, b: a + num(k) * (b - a)


BINARY: dict[str, Binary] = {"add": add, "sub": sub, "hadamard": hadamard, "quotient": divide, "and": both, "or": either, "equals": equals, "diff_sqr": diff_sqr, "misclassified": misclassified, "divides": divides, "sqr_plus": sqr_plus, "min": F.least, "max": F.greatest, "min_not_zero": min_not_zero, "greater": bigger, "less": smaller}


# --- a linear index (and the row i and column j that follow from it) ---


def seq(start: float, step: float) -> Unary:
    return lambda at: num(start) + at * num(step)


def seq_mod(phase: int, mod: int) -> Unary:
    return lambda at: ((at + F.lit(phase)) % F.lit(mod)).cast("double")


def span(start: float, end: float, steps: int) -> Unary:
    return lambda at: num(start) + at * num(end - start) / steps


def span_mod(start: float, end: float, steps: int) -> Unary:
    return lambda at: num(start) + num((end - start) / steps) * (at % steps)


def evens(phase: int = 0) -> Unary:
    return lambda at: (2 * at + (phase + (phase % 2 != 0))).cast("double")


def odds(phase: int = 0) -> Unary:
    return lambda at: (2 * at + (phase + (phase % 2 == 0))).cast("double")


def sin_wave(amplitude: float, period: float, phase: float) -> Unary:
    return lambda at: num(amplitude) * F.sin(num(2 * math.pi) * (at - num(phase)) / num(period))


def cos_wave(amplitude: float, period: float, phase: float) -> Unary:
    return lambda at: num(amplitude) * F.cos(num(2 * math.pi) * (at + num(phase)) / num(period))


def powers(base: float) -> Unary:
    return lambda at: F.pow(num(base), at.cast("double"))


def index_one_over(at: Column) -> Column:
    return F.when(at == 0, num(0)).otherwise(1 / F.nullif(at.cast("double"), F.lit(0.0)))


def index_step(at: Column) -> Column:
    return 1 / (1 + at.cast("double"))


def is_column(col: int, n: int) -> Unary:
    return lambda at: at % n == col


def is_row(row: int, n: int) -> Unary:
    return lambda at: F.floor(at / n) == row


INDEX: dict[str, Unary] = {"one_over": index_one_over, "step": index_step}
#: Named functions, for callers that choose one by name.
REGISTRY: dict[str, Callable] = {**UNARY, **{f"binary_{k}": v for k, v in BINARY.items()}, **{f"index_{k}": v for k, v in INDEX.items()}}
