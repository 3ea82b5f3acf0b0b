"""Column profiles, health, quality and trust scores.

Scalars of all columns come from one aggregation with partial sums on the map side;
frequencies of values come from one shuffle of (column, value) counts, which also gives
the distinct counts. Nothing is collected: results are small DataFrames, a row for each
column. NaN counts as missing in numeric columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from plumbline.functions import numbers as N
from plumbline.functions.text import is_numeric_field
from plumbline.operators.quantiles import quantile_row

# Weights of the trust score.
WEIGHTS = {"null": 0.35, "type": 0.20, "anomaly": 0.20, "benford": 0.15, "dup": 0.10}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    dtype = df.schema[name].dataType
    return F.when(~F.isnan(_c(name)), _c(name)) if dtype.typeName() in ("double", "float") else _c(name)


def _number(df: DataFrame, name: str) -> Column:
    return N.clean(_c(name).cast("double")) if is_numeric_field(df.schema[name].dataType) else F.lit(None).cast("double")


def wide_to_long(row: DataFrame, columns: Iterable[str], fields: dict[str, str]) -> DataFrame:
    """One aggregate row with ``<field>_<i>`` columns as (column, fields...), one row for each column."""
    parts = []
    for i, c in enumerate(columns):
        parts.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[F.col(f"{f}_{i}").cast(t).alias(f) for f, t in fields.items()]))
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def scalars(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: counts, moments and order statistics. Quantiles are exact, or approximate where ``exact`` is False."""
    columns = columns or df.columns
    aggs, numbers = [F.count("*").alias("n")], [i for i, c in enumerate(columns) if is_numeric_field(df.schema[c].dataType)]
    kinds = {"n": "long", "valid": "long", "mean": "double", "std": "double", "min": "double", "max": "double", "skew": "double", "kurt": "double", "median": "double", "numeric": "boolean", "digits_like": "double", "float_like": "double"}
    for i, c in enumerate(columns):
        x, v = _number(df, c), present(df, c)
        text = isinstance(df.schema[c].dataType, StringType)
        aggs += [
            F.count("*").alias(f"n_{i}"), F.count(v).alias(f"valid_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"),
            F.skewness(x).alias(f"skew_{i}"), F.kurtosis(x).alias(f"kurt_{i}"), F.lit(is_numeric_field(df.schema[c].dataType)).alias(f"numeric_{i}"),
            (F.avg(N.is_digits_like(_c(c)).cast("double")) if text else F.lit(None)).alias(f"digits_like_{i}"), (F.avg(N.is_float_like(_c(c)).cast("double")) if text else F.lit(None)).alias(f"float_like_{i}"),
        ]
    row = df.agg(*aggs)
    if numbers:
        row = row.crossJoin(F.broadcast(quantile_row(df, [_number(df, columns[i]) for i in numbers], [0.5], exact)))  # one row
    medians = [(F.get(f"q{numbers.index(i)}", F.lit(0)) if i in numbers else F.lit(None).cast("double")).alias(f"median_{i}") for i in range(len(columns))]
    return wide_to_long(row.select("*", *medians), columns, kinds)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text, count) of all non-null values."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct)."""
    row = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.count("*").alias(f"n_{i}"), F.count(present(df, c)).alias(f"valid_{i}"))])
    long = wide_to_long(row, df.columns, {"n": "long", "valid": "long"})
    miss = F.col("n") - F.col("valid")
    return long.select("column", miss.alias("missing_count"), F.round(100 * miss / F.greatest("n", F.lit(1)), 2).alias("missing_pct"))


def _health(s: DataFrame) -> Column:
    miss = 100 * (F.col("n") - F.col("valid")) / F.greatest("n", F.lit(1))
    wild = (F.col("valid") > 10) & (F.col("mean") != 0) & (F.col("std") / F.abs(F.nullif("mean", F.lit(0.0))) > 2)
    return F.when(miss > 5, "missing").when(F.coalesce(wild, F.lit(False)), "anomaly").otherwise("clean")


def column_health(df: DataFrame) -> DataFrame:
    """(column, health): missing above 5 % nulls, anomaly above a coefficient of variation of 2, else clean."""
    s = scalars_light(df)
    return s.select("column", _health(s).alias("health"))


def scalars_light(df: DataFrame) -> DataFrame:
    """Counts, mean and deviation only: a single pass without order statistics."""
    aggs, kinds = [], {"n": "long", "valid": "long", "mean": "double", "std": "double", "float_like": "double"}
    for i, c in enumerate(df.columns):
        x = _number(df, c)
        text = isinstance(df.schema[c].dataType, StringType)
        aggs += [F.count("*").alias(f"n_{i}"), F.count(present(df, c)).alias(f"valid_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev(x).alias(f"std_{i}"), (F.avg(N.is_float_like(_c(c)).cast("double")) if text else F.lit(None)).alias(f"float_like_{i}")]
    return wide_to_long(df.agg(*aggs), df.columns, kinds)


def column_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row for each column: missing and mismatch shares, quality score, distinct count and statistics."""
    columns = columns or df.columns
    s = scalars(df, columns, exact)
    unique = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_unique"))
    miss = 100 * (F.col("n") - F.col("valid")) / F.greatest("n", F.lit(1))
    mismatch = F.when((F.col("digits_like") > 0) & (F.col("digits_like") < 0.8), 100 * (1 - F.col("digits_like"))).otherwise(0.0)
    cv = F.coalesce(F.col("std") / F.nullif("mean", F.lit(0.0)), F.lit(0.0))
    wild = F.when((F.col("valid") > 5) & (cv > 3), F.least(F.lit(20.0), 2 * cv)).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100 - F.least(F.lit(50.0), 2 * miss) - F.least(F.lit(30.0), 0.5 * mismatch) - wild)
    return s.join(unique, "column", "left").select(
        "column", F.round(miss, 4).alias("miss_pct"), F.round(mismatch, 4).alias("type_mismatch_pct"), F.round(score, 1).alias("quality_score"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        *[F.round(k, 4).alias(k) for k in ("mean", "median", "std", "min", "max", "skew", "kurt")], _health(s).alias("health"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, rank, value, count, pct): the most frequent values; ties by value."""
    counts = value_counts(df, columns)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))).where(F.col("rank") <= k)
    total = df.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).select("column", "rank", "value", "count", F.round(100 * F.col("count") / F.col("_n"), 1).alias("pct"))  # one row


def quality_score(df: DataFrame) -> DataFrame:
    """(quality_score) of a dataset, 0 to 100."""
    s = scalars_light(df)
    miss = F.round(100 * (F.col("n") - F.col("valid")) / F.greatest("n", F.lit(1)), 2)
    per = s.select(miss.alias("miss"), (_health(s) == "anomaly").cast("double").alias("bad"))
    return per.agg(F.avg("miss").alias("m"), (100 * F.avg("bad")).alias("b")).select(
        F.round(F.greatest(F.lit(0.0), 100 - F.least(F.lit(40.0), 2 * F.col("m")) - F.least(F.lit(30.0), F.col("b"))), 1).alias("quality_score")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates); nulls compare equal. Counts travel, not rows: groups are made by hash and verified by value."""
    groups = df.groupBy(*[_c(c) for c in df.columns]).agg(F.count("*").alias("_k"))
    return groups.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def dedup_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row, in ``order`` (nulls first), of each combination of ``subset``. Aggregated before the shuffle, so a frequent combination is no one task's."""
    rows = df.select(F.struct(*[_c(c).alias(f"k{i}") for i, c in enumerate(subset)]).alias("key"), F.struct(*[_c(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("place"), F.struct(*[_c(c) for c in df.columns]).alias("row"))
    return rows.groupBy("key").agg(F.min_by("row", "place").alias("row")).select("row.*")


def _benford_penalty(df: DataFrame, column: str, min_n: int = 100) -> DataFrame:
    x = N.clean(_c(column).cast("double"))
    digits = df.where(x > 0).groupBy(N.first_digit(x).alias("digit")).agg(F.count("*").alias("k"))
    nine = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("e"))
    both = nine.join(digits, "digit", "left").select("e", F.coalesce("k", F.lit(0)).alias("k"))
    agg = both.agg(F.sum("k").alias("n"), F.collect_list(F.struct("k", "e")).alias("d"))
    mad = F.aggregate("d", F.lit(0.0), lambda a, d: a + F.abs(d["k"] / F.greatest("n", F.lit(1)) - d["e"])) / 9
    return agg.select(F.when(F.col("n") >= min_n, F.least(F.lit(1.0), mad / 0.15)).otherwise(0.0).alias("benford"), (F.col("n") >= min_n).alias("benford_used"))


def trust_score(df: DataFrame, benford_col: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: score, grade, and the five components of the multiplicative trust score."""
    w = weights or WEIGHTS
    s = scalars_light(df)
    r = F.col("float_like")
    kind = F.when((r > 0.05) & (r < 0.95), 2 * F.least(r, 1 - r)).otherwise(0.0)
    per = s.select(((F.col("n") - F.col("valid")) / F.greatest("n", F.lit(1))).alias("null"), kind.alias("type"), (F.col("valid") > 10).alias("big"), "mean", "std")
    wild = F.coalesce((F.col("big")) & (F.col("mean") != 0) & (F.col("std") / F.abs(F.nullif("mean", F.lit(0.0))) > 2), F.lit(False))
    parts = per.agg((0.6 * F.avg("null") + 0.4 * F.max("null")).alias("null"), F.avg("type").alias("type"), F.avg(wild.cast("double")).alias("anomaly"))
    dup = duplicate_count(df).select((F.col("n_duplicates") / F.greatest("n_rows", F.lit(1))).alias("dup"))
    ben = _benford_penalty(df, benford_col) if benford_col and benford_col in df.columns else df.sparkSession.range(1).select(F.lit(0.0).alias("benford"), F.lit(False).alias("benford_used"))
    row = parts.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(ben))  # one row each
    product = F.lit(1.0)
    for k in WEIGHTS:
        product = product * (1 - w[k] * F.col(k))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * product)), 1)
    return row.select(score.alias("score"), N.grade(score).alias("grade"), *[F.round(k, 4).alias(f"p_{k}") for k in WEIGHTS], "benford_used")


def column_penalties(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(column, null_pct, type_mismatch_pct, health, quality_score, penalty), the worst first; ties by column."""
    w = weights or WEIGHTS
    s = scalars_light(df)
    r = F.col("float_like")
    null, kind = (F.col("n") - F.col("valid")) / F.greatest("n", F.lit(1)), F.when((r > 0.05) & (r < 0.95), 2 * F.least(r, 1 - r)).otherwise(0.0)
    pen = w["null"] * null + w["type"] * kind
    out = s.select("column", F.round(100 * null, 2).alias("null_pct"), F.round(100 * kind, 2).alias("type_mismatch_pct"), _health(s).alias("health"), F.round(F.greatest(F.lit(0.0), 100 * (1 - pen)), 1).alias("quality_score"), F.round(pen, 4).alias("penalty"))
    return out.orderBy(F.desc("penalty"), "column")


def issues(score: DataFrame, n_duplicates: int, n_anomalies: int) -> list[str]:
    """At most five plain-language findings of a trust score row (a small driver-side result)."""
    p = score.first().asDict()
    out = []
    if p["p_null"] > 0.20:
        out.append(f"Missing share is high ({100 * p['p_null']:.1f} %): impute or drop columns.")
    elif p["p_null"] > 0.05:
        out.append(f"Some values are missing ({100 * p['p_null']:.1f} %): imputation is possible.")
    if p["p_type"] > 0.10:
        out.append(f"Mixed types in {100 * p['p_type']:.0f} % of the columns' cells.")
    if n_anomalies:
        out.append(f"{n_anomalies} columns vary more than twice their mean: look for outliers.")
    if n_duplicates:
        out.append(f"{n_duplicates} duplicate rows.")
    if p["p_benford"] > 0.5:
        out.append("Leading digits stray far from Benford's law.")
    return (out or ["No notable quality issue."])[:5]


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        x = _number(df, c)
        aggs += [F.count(x).alias(f"k_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev(x).alias(f"std_{i}"), F.variance(x).alias(f"var_{i}"), F.skewness(x).alias(f"skew_{i}"), F.kurtosis(x).alias(f"kurt_{i}")]
    return wide_to_long(df.agg(*aggs), columns, {"k": "long", **dict.fromkeys(("mean", "std", "var", "skew", "kurt"), "double")})


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Moments of common numeric columns before and after, the change of variance, and whether it is radical (above 20 %)."""
    columns = [c for c in before.columns if c in after.columns and is_numeric_field(before.schema[c].dataType)]
    keys = ("mean", "std", "var", "skew", "kurt")
    b = _moments(before, columns).select("column", F.col("k").alias("kb"), *[F.col(k).alias(f"{k}_b") for k in keys])
    a = _moments(after, columns).select("column", F.col("k").alias("ka"), *[F.col(k).alias(f"{k}_a") for k in keys])
    change = F.round(100 * (F.col("var_a") - F.col("var_b")) / F.abs(F.nullif("var_b", F.lit(0.0))), 2)
    both = b.join(F.broadcast(a), "column").where("kb >= 2 and ka >= 2")  # a row for each column
    pairs = [x for k in keys for x in (F.round(f"{k}_b", 4).alias(f"{k}_before"), F.round(f"{k}_a", 4).alias(f"{k}_after"))]
    return both.select("column", *pairs, change.alias("var_change_pct"), F.coalesce(F.abs(change) > 20, F.lit(False)).alias("radical_change"))


def effect_size(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Change of mean and variance in percent and Cohen's d between two versions of a column."""
    b, a = _moments(before, [column]), _moments(after, [column])
    row = b.select(F.col("k").alias("kb"), F.col("mean").alias("mb"), F.col("std").alias("sb"), F.col("var").alias("vb")).crossJoin(F.broadcast(a.select(F.col("k").alias("ka"), F.col("mean").alias("ma"), F.col("std").alias("sa"), F.col("var").alias("va"))))
    d = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt((F.col("sb") ** 2 + F.col("sa") ** 2) / 2))
    ok = (F.col("kb") >= 2) & (F.col("ka") >= 2)
    pct = lambda x, y: F.round(100 * F.try_divide(F.col(x) - F.col(y), F.abs(y)), 4)
    return row.select(F.lit(column).alias("column"), F.when(ok, pct("ma", "mb")).alias("delta_mean_pct"), F.when(ok, pct("va", "vb")).alias("delta_var_pct"), F.when(ok, F.round(F.coalesce(d, F.lit(0.0)), 4)).alias("cohen_d"), F.when(ok, N.d_label(F.coalesce(d, F.lit(0.0)))).otherwise("unavailable").alias("label"))
