"""Distinct values, counted sets, frequencies and set algebra over columns of values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.plans.matrix import Matrix
from gridloom.plans.workspace import fresh, ship

#: Values of a group that one task takes in order.
ORDERED_VALUES = 100_000
#: Combinations that a grid may have.
GRID_ROWS = 10_000_000


def distinct(x: Matrix) -> DataFrame:
    """Rows v: the distinct cells."""
    return x.to_coo().df.select("v").distinct()


def distinct_count(x: Matrix, approximate: bool = False) -> int:
    how = F.approx_count_distinct if approximate else F.count_distinct
    return x.to_coo().df.agg(how("v")).first()[0]


def frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (col, value, cnt, freq, entropy, depth): for each column its values, their counts and shares, -f log2 f, and how many values there are. Values are strings, so columns may be of any kind.

    All columns go in one pass and one shuffle of partial counts.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols))).alias("s")).select("s.*")
    counts = long.groupBy("col", "value").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy("col").agg(F.sum("cnt").alias("m"), F.count("*").alias("depth"))
    f = F.col("cnt") / F.col("m")
    return counts.join(totals, "col").select("col", "value", "cnt", f.alias("freq"), (-f * F.log2(f)).alias("entropy"), "depth")


def column_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (col, entropy)."""
    return frequencies(df, cols).groupBy("col").agg(F.sum("entropy").alias("entropy"))


def counted(df: DataFrame, value: str) -> DataFrame:
    """The counted set: rows (v, cnt)."""
    return df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("cnt"))


def counters(df: DataFrame, value: str) -> DataFrame:
    """Each value with the count 1."""
    return df.select(F.col(value).alias("v"), F.lit(1).cast("long").alias("cnt"))


def merge_counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two counted sets as one."""
    return a.union(b).groupBy("v").agg(F.sum("cnt").alias("cnt"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two sets: each value once."""
    return a.union(b).distinct()


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sets in order, each value once."""
    return merge(a, b).orderBy("v")


def merge_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sets in order, duplicates kept, those of a first."""
    return a.select("v", F.lit(0).alias("side")).union(b.select("v", F.lit(1).alias("side"))).orderBy("v", "side")


def first_seen(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Rows (v, pos): each distinct value at its first place."""
    return df.groupBy(F.col(value).alias("v")).agg(F.min(pos).alias("pos"))


def almost_distinct(df: DataFrame, value: str, pos: str, eps: float, group: str | None = None) -> DataFrame:
    """Values within eps of a value seen before count with the first such one: rows (v, cnt), by group if there is one.

    The result depends on the order and cannot be split, so each group is one task; a group of more than ORDERED_VALUES values is
    refused. ``counted`` is the form of any size.
    """
    ship(df.sparkSession)
    df = df.select((F.lit("") if group is None else F.col(group).cast("string")).alias("grp"), F.col(value).cast("double").alias("v"), F.col(pos).alias("pos"))

    if not df.groupBy("grp").count().where(F.col("count") > ORDERED_VALUES).isEmpty():
        raise errors.TooLarge(f"a group of more than {ORDERED_VALUES} values")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        counts: list[int] = []
        for v in part.sort_values("pos")["v"]:
            k = next((k for k, x in enumerate(kept) if v == x or abs(v - x) < eps), None)
            if k is None:
                kept.append(v)
                counts.append(1)
            else:
                counts[k] += 1
        return pd.DataFrame({"grp": part["grp"].iloc[0], "v": kept, "cnt": counts})

    return df.groupBy("grp").applyInPandas(run, "grp string, v double, cnt long")


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """df with rank, from 0, in the order of value, then key. Ranges of the order are sorted side by side and stored; counts by range give each one's first rank, so no task sorts or numbers the whole."""
    spark = df.sparkSession
    path = f"{fresh(spark, 'ranked')}/rows"
    df.repartitionByRange(value, key).sortWithinPartitions(value, key).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema(df.withColumn("range_", F.lit(0)).schema).parquet(path)
    sizes = stored.groupBy(F.col("range_").alias("r_")).agg(F.count("*").alias("n_"))
    first = F.coalesce(F.sum("n_").over(Window.orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(value, key)) - 1
    placed = stored.withColumn("in_", inside).join(F.broadcast(sizes.select("r_", first.alias("first_"))), F.col("range_") == F.col("r_"))
    return placed.select(*df.columns, (F.col("first_") + F.col("in_")).cast("long").alias("rank"))


def sorted_values(df: DataFrame, value: str) -> DataFrame:
    return df.orderBy(value)


def sorted_array(values: Column) -> Column:
    return F.array_sort(values)


def jaccard(a: Column, b: Column) -> Column:
    """Of two array columns; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def jaccard_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the Jaccard index of two tables of values v, of any size. One union and one aggregate by value."""
    sides = a.select("v", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("v", F.lit(0), F.lit(1)))
    each = sides.groupBy("v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg((F.sum(F.col("a") * F.col("b")) / F.nullif(F.count("*"), F.lit(0))).alias("jaccard"))


#: How two intervals may lie.
RELATIONS = ("a_before_b", "a_on_b", "b_in_a", "b_on_a", "a_in_b", "b_before_a")


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How [a0, a1] and [b0, b1] lie; what begins first is looked at first."""
    a_first = F.when(a1 <= b0, RELATIONS[0]).when(a1 <= b1, RELATIONS[1]).otherwise(RELATIONS[2])
    b_first = F.when(b1 < a0, RELATIONS[5]).when(b1 <= a1, RELATIONS[3]).otherwise(RELATIONS[4])
    return F.when(a0 <= b0, a_first).otherwise(b_first)


def ranges(*lists: DataFrame) -> DataFrame:
    """All combinations of one value from each list, columns v0, v1, ... For parameter grids; more than GRID_ROWS combinations are refused."""
    sizes = [d.limit(GRID_ROWS + 1).count() for d in lists]
    if math.prod(sizes) > GRID_ROWS:
        raise errors.TooLarge(f"{sizes} values")
    out = lists[0].select(F.col("v").alias("v0"))
    for k, d in enumerate(lists[1:], 1):
        out = out.join(F.broadcast(d.select(F.col("v").alias(f"v{k}"))), how="cross")
    return out


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows (bin, cnt) of equal widths from low to high; values outside go to the ends."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("cnt"))

