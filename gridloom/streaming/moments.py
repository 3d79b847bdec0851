"""Running statistics of a stream of numeric rows; the batch functions' means and variances by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, value: str, by: str | None = None, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows (start, end[, by], n, mean, var) for each tumbling window; rows that come later than ``late`` behind the newest are left out. Works on streams and tables alike."""
    keys = [F.window(time, width).alias("w")] + ([F.col(by)] if by else [])
    out = stream.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([by] if by else []), "n", "mean", "var")


def scored(stream: DataFrame, value: str, mu: float, var: float) -> DataFrame:
    """Each row with its Gaussian density under fixed parameters: a projection, so it needs no state."""
    from gridloom.operators.anomaly import density

    return stream.withColumn("p", density(F.col(value), F.lit(mu), F.lit(var)))
