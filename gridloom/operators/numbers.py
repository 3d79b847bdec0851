"""Number theory and small scalar mathematics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten-thousandth prime: factors are looked for among the primes up to here.
LARGEST_PRIME = 104_729


def primes_upto(n: int) -> np.ndarray:
    sieve = np.ones(n + 1, bool)
    sieve[:2] = False
    for p in range(2, int(n**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)


def primes(spark: SparkSession, upto: int = LARGEST_PRIME) -> DataFrame:
    """Rows p."""
    return spark.createDataFrame([(int(p),) for p in primes_upto(upto)], "p long")


def prime_factors(df: DataFrame, value: str) -> DataFrame:
    """df with smallest_factor and largest_factor among the known primes, and is_prime. Values under 4 are their own factors; null if no known prime divides.

    Each value is tried against an array of the primes up to the root, and what is left after dividing is the last factor: no join.
    """
    v = F.col(value).cast("long")
    table = F.array(*(F.lit(int(p)) for p in primes_upto(int(LARGEST_PRIME**0.5) + 1)))
    small = F.filter(table, lambda p: v % p == 0)
    # what is left of v when every small prime is divided out as often as it goes: a 64-bit number has no factor more than 63 times
    rest = F.aggregate(small, v, lambda a, p: F.aggregate(F.sequence(F.lit(1), F.lit(63)), a, lambda b, _: F.when(b % p == 0, F.floor(b / p).cast("long")).otherwise(b)))
    known = F.when((rest > 1) & (rest <= LARGEST_PRIME), rest)
    low = F.when(v < 4, v).otherwise(F.coalesce(F.array_min(small), known))
    high = F.when(v < 4, v).otherwise(F.coalesce(known, F.array_max(small)))
    return df.withColumns({"smallest_factor": low, "largest_factor": high, "is_prime": (v > 1) & (v == high)})


def common_factors(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with smallest_common and largest_common, the prime factors that both have; null if there are none. They are those of the greatest common divisor."""
    # Euclid's steps; 64-bit numbers need fewer than 93
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.nullif(s["y"], F.lit(0).cast("long"))).alias("y"))), lambda s: s["x"])
    found = prime_factors(df.withColumn("gcd_", F.abs(gcd)), "gcd_")
    some = lambda c: F.when(F.col("gcd_") > 1, F.col(c))
    return found.withColumns({"smallest_common": some("smallest_factor"), "largest_common": some("largest_factor")}).drop("gcd_", "smallest_factor", "largest_factor", "is_prime")


def modulus(a: Column, b: Column) -> Column:
    return a % b


def bit_count(a: Column) -> Column:
    return F.bit_count(a)


def is_power_of_two(a: Column) -> Column:
    return (a > 0) & (a.bitwiseAND(a - 1) == 0)


def next_power_of_two(a: Column) -> Column:
    """The least power of two that is not smaller, by spreading the highest bit of a - 1 downwards."""
    b = a.cast("long") - 1
    for k in (1, 2, 4, 8, 16, 32):
        b = b.bitwiseOR(F.shiftright(b, k))
    return F.when(a <= 1, F.lit(1).cast("long")).otherwise(b + 1)


def gradient(f: Callable[[Column], Column], x: Column, h: float = 1e-4) -> Column:
    return (f(x + h) - f(x - h)) / (2 * h)


def roots(spark: SparkSession, f: Callable[[Column], Column], low: float, high: float, slices: int = 1024, eps: float = 1e-10, most: int = 64) -> DataFrame:
    """Rows root: where f changes its sign between slices, halved until the interval is under eps; all slices at once, no action."""
    width = (high - low) / slices
    rows = spark.range(slices).select((F.lit(low) + F.col("id") * width).alias("a"), (F.lit(low) + (F.col("id") + 1) * width).alias("b"))
    rows = rows.where((F.signum(f(F.col("a"))) * F.signum(f(F.col("b"))) < 0) | (f(F.col("a")) == 0))
    halvings = max(1, int(np.ceil(np.log2(max(width / eps, 2)))))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        left = F.signum(f(s["a"])) * F.signum(f(mid)) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(s["b"]).alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.col("a").alias("a"), F.col("b").alias("b")), halve)
    return rows.select(done.alias("s")).select(((F.col("s.a") + F.col("s.b")) / 2).alias("root")).orderBy("root").limit(most)


def outside_circle(x: Column, y: Column, cx: float, cy: float, r: float, eps: float) -> Column:
    """eps^2 > r^2 - dx^2 - dy^2: beyond the circle, or near its edge from within."""
    return F.lit(eps * eps) > F.lit(r * r) - (x - cx) * (x - cx) - (y - cy) * (y - cy)


# --- quaternions: structs of w, x, y, z ---


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def q_add(p: Column, q: Column) -> Column:
    return quaternion(*(p[c] + q[c] for c in "wxyz"))


def q_mul(p: Column, q: Column) -> Column:
    return quaternion(
        p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
        p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
        p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
        p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
    )


def q_conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def q_norm(q: Column) -> Column:
    """The squared length."""
    return q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]


def q_inverse(q: Column) -> Column:
    c, n = q_conjugate(q), q_norm(q)
    return quaternion(*(c[k] / n for k in "wxyz"))


def cross3(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
