"""Exact quantiles of many columns, without a buffer of all distinct values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize

#: Estimated bytes of the values up to which one aggregation buffer holds them; beyond, they are ranked over all tasks.
ONE_BUFFER = 256 << 20


def quantile_row(df: DataFrame, xs: list[Column], probs: list[float], exact: bool = True, one_buffer: int = ONE_BUFFER) -> DataFrame:
    """One row with an array ``q<i>`` of the quantiles of each column expression (doubles; null without values).

    ``exact=False`` takes approximate ones. Exact ones are the same by either path.
    """
    if not exact:
        return df.agg(*[F.percentile_approx(x, probs, 100_000).alias(f"q{i}") for i, x in enumerate(xs)])
    values = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)])
    if values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < one_buffer:
        return values.agg(*[F.percentile(f"x{i}", probs).alias(f"q{i}") for i in range(len(xs))])
    return distributed_quantiles(values, probs)


def distributed_quantiles(values: DataFrame, probs: list[float]) -> DataFrame:
    """As ``quantile_row``, for all columns of ``values``: counts of distinct values are cut by range, and running counts tell places."""
    n = len(values.columns)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(values.columns)]))
    counts = values.select(cells.alias("c")).select("c.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("k"))
    parts = materialize(counts.repartitionByRange("i", "v").withColumn("p", F.spark_partition_id()), "quantiles")
    sums = parts.groupBy("p", "i").agg(F.sum("k").alias("s"))  # a row for each partition and column
    before = F.coalesce(F.sum("s").over(Window.partitionBy("i").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("p", "i", before.alias("base"), F.sum("s").over(Window.partitionBy("i")).alias("n"))
    running = F.sum("k").over(Window.partitionBy("p", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("end", running).join(F.broadcast(sums), ["p", "i"])
    end = F.col("base") + F.col("end")
    at = lambda place: F.max(F.when((end - F.col("k") <= place) & (place < end), F.col("v")))
    found = []
    for j, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - 1)
        found += [at(F.floor(place)).alias(f"f{j}"), at(F.ceil(place)).alias(f"c{j}"), F.max(place - F.floor(place)).alias(f"d{j}")]
    each = placed.groupBy("i").agg(*found)
    between = lambda f, c, d: F.when(f == c, f).otherwise(f * (1 - d) + c * d)
    q = F.array(*[between(F.col(f"f{j}"), F.col(f"c{j}"), F.col(f"d{j}")) for j in range(len(probs))])
    return each.select("i", q.alias("q")).groupBy().agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(n)])
