"""Row and column edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPS = {"==": "=", "=": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[f"`{c}`" for c in columns if c in df.columns])


def filter_rows(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows where ``column op value`` holds."""
    c = F.col(f"`{column}`")
    if op not in _OPS:
        raise ValueError(f"unknown operator {op}")
    return df.where({"=": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[_OPS[op]])


def keep_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.where(F.expr(condition))


def drop_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition isn't true (rows where it is unknown stay)."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def drop_by_id(df: DataFrame, ids: DataFrame | list[int], rid: str = "_rid") -> DataFrame:
    """Rows whose id isn't listed; ids that don't exist are ignored."""
    if isinstance(ids, list):
        return df.where(~F.col(f"`{rid}`").isin(ids)) if len(ids) <= 1000 else drop_by_id(df, df.sparkSession.createDataFrame([(i,) for i in ids], f"`{rid}` long"), rid)
    return df.join(ids.select(F.col(f"`{rid}`").alias("_gone")), F.col(f"`{rid}`") == F.col("_gone"), "left_anti")


def with_rid(df: DataFrame, order: str | None = None, rid: str = "_rid") -> DataFrame:
    """Row numbers from 0: by ``order`` where given, else in the order in which partitions are read."""
    if order is not None:
        from pyspark.sql import Window

        from plumbline.runtime import materialize

        parts = materialize(df.repartitionByRange(F.col(f"`{order}`")).withColumn("_p", F.spark_partition_id()), "rid")
        sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
        base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each partition
        inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(f"`{order}`"))) - 1
        return parts.withColumn("_k", inside).join(F.broadcast(base), "_p").select(*[f"`{c}`" for c in df.columns], (F.col("_b") + F.col("_k")).alias(rid))
    return df.withColumn(rid, F.monotonically_increasing_id())


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """To numeric, str or datetime; what can't be cast becomes null, nulls stay null."""
    c = F.col(f"`{column}`")
    to = {"numeric": lambda: c.try_cast("double"), "str": lambda: c.cast("string"), "datetime": lambda: F.try_to_timestamp(c.cast("string"))}
    if kind not in to:
        raise ValueError(f"unknown type {kind}")
    return df.withColumn(column, to[kind]())


def sort_rows(df: DataFrame, columns: list[str], ascending: bool = True) -> DataFrame:
    """Nulls last in both directions."""
    return df.orderBy(*[(F.col(f"`{c}`").asc_nulls_last() if ascending else F.col(f"`{c}`").desc_nulls_last()) for c in columns])


def custom(df: DataFrame, fn) -> DataFrame:
    return df.transform(fn)


def frame_hash(df: DataFrame) -> DataFrame:
    """One row: count, and the sum and xor of row hashes; independent of row order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def value_hash(*columns: str):
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
