"""The same Column expressions on streams: text normalisation, frozen outlier bounds and windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.functions.text import DEFAULT_OPERATIONS, apply_operations


def normalize_stream(stream: DataFrame, columns: list[str], operations=DEFAULT_OPERATIONS) -> DataFrame:
    """Named text columns normalised row by row; no state."""
    return stream.select(*[apply_operations(F.col(f"`{c}`"), operations).alias(c) if c in columns else F.col(f"`{c}`") for c in stream.columns])


def flag_outliers(stream: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """``is_outlier`` by bounds that were computed on a batch."""
    x = N.clean(F.col(f"`{column}`").cast("double"))
    return stream.withColumn("is_outlier", F.coalesce((x < lower) | (x > upper), F.lit(False)))


def windowed_profile(stream: DataFrame, column: str, time: str, window: str = "5 minutes", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts and moments of a column for each time window; state for windows older than the watermark is dropped."""
    x = N.clean(F.col(f"`{column}`").cast("double"))
    t = stream.withColumn("_t", F.col(f"`{time}`").cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy(F.window("_t", window), *[F.col(f"`{b}`") for b in by or []])
    out = g.agg(F.count("*").alias("n"), F.count(x).alias("valid"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "n", "valid", "mean", "std", "min", "max")


def benford_stream(stream: DataFrame, column: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """First-digit counts of positive values for each time window."""
    x = N.clean(F.col(f"`{column}`").cast("double"))
    t = stream.withColumn("_t", F.col(f"`{time}`").cast("timestamp")).withWatermark("_t", late).where(x > 0)
    return t.groupBy(F.window("_t", window), N.first_digit(x).alias("digit")).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "digit", "count")
