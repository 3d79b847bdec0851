"""Reproducible shuffles and exact train / validation / test splits.

The order follows from a hash of seed and key, so the same seed keeps X and y aligned and a lost task gives the same again.
Ranks are exact but never sorted in one task: keys fall into bins by the leading part of the hash, counts by bin give each
bin's first rank, and rows are ranked in their bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import errors

BINS = 4096
PRIME = 2_147_483_647


def integer_hash(key: Column, seed: int) -> Column:
    """A number below 2^31 - 1 by whole-number arithmetic that any SQL engine gives alike: two rounds of multiply and add."""
    a = F.pmod(F.pmod(key, F.lit(PRIME)) * F.lit(48271) + F.lit(seed), F.lit(PRIME))
    return F.pmod(F.pmod(a, F.lit(65536)) * F.lit(32749) + F.floor(a / 65536).cast("long") * F.lit(40503) + a, F.lit(PRIME))


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """df with rank, its place from 0 in the seeded order. Keys should be distinct; equal ones share no fixed order."""
    h = df.withColumn("h_", integer_hash(F.col(key).cast("long"), seed)).withColumn("bin_", F.floor(F.col("h_") * F.lit(BINS) / F.lit(PRIME)).cast("int"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = h.groupBy("bin_").agg(F.count("*").alias("n_")).withColumn("before_", before).drop("n_")
    inside = F.row_number().over(Window.partitionBy("bin_").orderBy("h_", key)) - 1
    return h.withColumn("in_", inside).join(F.broadcast(firsts), "bin_").withColumn("rank", (F.col("before_") + F.col("in_")).cast("long")).drop("h_", "bin_", "in_", "before_")


def split(df: DataFrame, key: str, fraction: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first round(m * fraction) rows of the seeded order, and the rest (one count)."""
    if not 0 <= fraction <= 1:
        raise errors.OutOfBounds(f"fraction {fraction}")
    cut = int(df.count() * fraction + 0.5)
    ranked = shuffled(df, key, seed)
    return ranked.where(F.col("rank") < cut).drop("rank"), ranked.where(F.col("rank") >= cut).drop("rank")


def validation_sets(df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, seed: int = 1) -> DataFrame:
    """df with part: train, validation or test. The validation share is taken of what training leaves over, so that it is a share of all rows."""
    m = df.count()
    first = int(m * train + 0.5)
    left = m - first
    second = first + (int(left * min(1.0, validation * m / left) + 0.5) if left else 0)
    part = F.when(F.col("rank") < first, "train").when(F.col("rank") < second, "validation").otherwise("test")
    return shuffled(df, key, seed).withColumn("part", part).drop("rank")
