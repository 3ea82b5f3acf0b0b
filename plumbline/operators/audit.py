"""Statistical audit: descriptives, histogram, normality, Benford's law, outliers, variance impact, correlation.

Statistics are aggregations; tail probabilities are computed from the one-row results.
Exact quantiles of large tables are found by ranks over all tasks (``quantiles``);
``exact=False`` takes ``percentile_approx`` instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.functions import special as S
from plumbline.operators.quantiles import quantile_row
from plumbline.runtime import materialize

# Nigrini's limits of the mean absolute deviation.
NIGRINI = (("Close conformity", 0.006), ("Acceptable conformity", 0.012), ("Marginal conformity", 0.015))


def values(df: DataFrame, column: str) -> Column:
    """A numeric column as clean doubles, a text column read as numbers; what isn't a number is null."""
    c = F.col(f"`{column}`")
    return N.to_number(c) if df.schema[column].dataType.typeName() == "string" else N.clean(c)


def describe(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """n, mean, std and variance (population), min, quartiles, max, skewness and excess kurtosis."""
    x = values(df, column)
    row = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    ).crossJoin(F.broadcast(quantile_row(df, [x], [0.25, 0.5, 0.75], exact)))
    q = lambda i: F.get("q0", F.lit(i))
    rounded = [F.round(c, 4).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("var", F.col("var")), ("min", F.col("min")), ("q1", q(0)), ("median", q(1)), ("q3", q(2)), ("max", F.col("max")), ("skew", F.col("skew")), ("kurt", F.col("kurt")))]
    return row.select("n", *rounded)


def histogram(df: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """(bin, lo, hi, count) of equal-width bins over [min, max], the last one closed; a constant column widens by half to each side."""
    x = values(df, column)
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    counts = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(ends)).groupBy(F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("count"))  # one row of ends
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * width, 4).alias("lo"), F.round(F.col("lo") + F.col("bin") * width, 4).alias("hi"), F.coalesce("count", F.lit(0)).alias("count")).where("lo is not null")


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, biased skewness and excess kurtosis."""
    x = values(df, column)
    return df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def normality_moments(df: DataFrame, column: str) -> DataFrame:
    """D'Agostino-Pearson K2 and p from three aggregates, all in Column expressions (n of 8 or more)."""
    n, b1, b2 = F.col("n").cast("double"), F.col("skew"), F.col("kurt") + 3
    m = moments(df, column)
    y = b1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    xx = (b2 - e) / F.sqrt(v)
    rb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / rb * (2 / rb + F.sqrt(1 + 4 / (rb * rb)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + xx * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return m.where("n >= 8").select("n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), F.round(k2, 4).alias("k2"), F.round(F.exp(-k2 / 2), 6).alias("p_value"))


SHAPIRO_BELOW = 5000


def normality(df: DataFrame, column: str, alpha: float = 0.05, alpha_large: float | None = 0.001) -> dict:
    """Shapiro-Wilk below 5000 values, else D'Agostino-Pearson with ``alpha_large`` (None keeps ``alpha``)."""
    m = moments(df, column).first()
    n, skew, kurt = m["n"], m["skew"] or 0.0, m["kurt"] or 0.0
    if n < 3:
        raise ValueError("at least 3 values are needed")
    if n < SHAPIRO_BELOW:
        x = values(df, column)
        w, p = S.shapiro_wilk([r[0] for r in df.select(x).where(x.isNotNull()).collect()])  # fewer than SHAPIRO_BELOW values
        test = "Shapiro-Wilk"
    else:
        w, p = S.dagostino_k2(n, skew, kurt)
        test, alpha = "D'Agostino-Pearson", alpha_large or alpha
    normal, size = p > alpha, abs(skew)
    method = "zscore" if normal and size < 0.5 else "robust_zscore" if abs(kurt) > 3 or size >= 1 else "iqr"
    label = "symmetric" if size < 0.5 else "moderately skewed" if size < 1 else "highly skewed"
    return {"test": test, "n": n, "statistic": w, "p_value": p, "alpha": alpha, "is_normal": normal, "skew": skew, "kurt": kurt, "skew_label": label, "recommended": method, "note": expert_note(normal, skew, kurt, n)}


_NOTES = {
    "en": {
        "large": "With {n} values, normality tests react to small deviations; this is an observation, not an error. ", "z": "The classical z-score (threshold 3) fits.", "mild": "Slightly skewed: the interquartile range (1.5) is safer than the z-score.",
        "heavy": "Heavy tails: consider the robust z-score.", "skewed": "Strongly skewed: use the interquartile range or the robust z-score.", "other": "Not normal: prefer the interquartile range or the robust z-score.", "small": " Small sample ({n}): interpret with care.",
    },
    "tr": {
        "large": "{n} değerle normallik testleri küçük sapmalara duyarlıdır; bu bir gözlemdir. ", "z": "Klasik z-skoru (eşik 3) uygundur.", "mild": "Hafif çarpık: çeyrekler açıklığı (1.5) daha güvenlidir.",
        "heavy": "Kalın kuyruklar: dayanıklı z-skorunu değerlendirin.", "skewed": "Belirgin çarpık: çeyrekler açıklığı veya dayanıklı z-skoru kullanın.", "other": "Normal değil: çeyrekler açıklığı veya dayanıklı z-skoru tercih edin.", "small": " Küçük örneklem ({n}): dikkatle yorumlayın.",
    },
}


def expert_note(is_normal: bool, skew: float, kurt: float, n: int, lang: str = "en") -> str:
    """Which outlier method suits a distribution, in words."""
    t, size = _NOTES[lang], abs(skew)
    key = "z" if is_normal and size < 0.5 else "mild" if is_normal and size < 1 else "heavy" if kurt > 3 else "skewed" if size >= 1 else "other"
    return (t["large"].format(n=n) if n > 5000 and not is_normal else "") + t[key] + (t["small"].format(n=n) if n < 50 else "")


def benford_digits(df: DataFrame, column: str) -> DataFrame:
    """(digit, count, obs_pct, exp_pct, diff_pct, suspicious) of positive values' first digits."""
    x = values(df, column)
    counts = df.where(x > 0).groupBy(N.first_digit(x).alias("digit")).agg(F.count("*").alias("count"))
    nine = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("e"))
    both = nine.join(F.broadcast(counts), "digit", "left").select("digit", "e", F.coalesce("count", F.lit(0)).alias("count"))  # nine rows
    n = F.sum("count").over(Window.partitionBy())
    obs, exp = F.round(100 * F.col("count") / F.nullif(n, F.lit(0)), 2), F.round(100 * F.col("e"), 2)
    return both.select("digit", "count", obs.alias("obs_pct"), exp.alias("exp_pct"), F.round(obs - exp, 2).alias("diff_pct"), (F.abs(F.round(obs - exp, 2)) > 3).alias("suspicious"))


def benford_verdict(df: DataFrame, column: str) -> DataFrame:
    """One row: n, chi2 (8 degrees of freedom), mad, conformity and whether the deviation is suspicious."""
    x = values(df, column)
    counts = df.where(x > 0).groupBy(N.first_digit(x).alias("digit")).agg(F.count("*").alias("count"))
    nine = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("e"))
    both = nine.join(F.broadcast(counts), "digit", "left").select("e", F.coalesce("count", F.lit(0)).alias("k"))
    row = both.withColumn("n", F.sum("k").over(Window.partitionBy())).agg(F.max("n").alias("n"), F.sum(F.pow(F.col("k") - F.col("n") * F.col("e"), F.lit(2)) / F.nullif(F.col("n") * F.col("e"), F.lit(0.0))).alias("chi2"), F.avg(F.abs(F.try_divide("k", "n") - F.col("e"))).alias("mad"))
    label = F.lit("Nonconformity")
    for name, limit in reversed(NIGRINI):
        label = F.when(F.col("mad") <= limit, name).otherwise(label)
    return row.select("n", F.round("chi2", 4).alias("chi2"), F.round("mad", 6).alias("mad"), label.alias("conformity"), (F.col("mad") > NIGRINI[-1][1]).alias("suspicious"))


def benford(df: DataFrame, column: str, alpha: float = 0.05, min_n: int = 100) -> dict:
    """Verdict with the chi-square p-value; fewer than ``min_n`` positive values are an error."""
    row = benford_verdict(df, column).first().asDict()
    if row["n"] < min_n:
        raise ValueError(f"{row['n']} positive values; {min_n} are needed")
    row["p_value"] = S.chi2_sf(row["chi2"], 8)
    return row | {"rejects": row["p_value"] < alpha, "digits": [r.asDict() for r in benford_digits(df, column).orderBy("digit").collect()]}


def _flag(df: DataFrame, column: str, bounds: DataFrame, is_outlier: Column) -> DataFrame:
    """``df`` as ``row`` beside ``_x``, its value, and the one row of ``bounds``; the user's columns keep any names."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), values(df, column).alias("_x"))
    return whole.crossJoin(F.broadcast(bounds)).where(is_outlier)


def iqr_bounds(df: DataFrame, column: str, multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    q = quantile_row(df, [values(df, column)], [0.25, 0.75], exact).select(F.get("q0", F.lit(0)).alias("q1"), F.get("q0", F.lit(1)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - multiplier * iqr).alias("lower"), (F.col("q3") + multiplier * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """The rows of ``df`` strictly outside the whiskers, with the bounds."""
    out = _flag(df, column, iqr_bounds(df, column, multiplier, exact), (F.col("_x") < F.col("lower")) | (F.col("_x") > F.col("upper")))
    return out.select("row.*", "lower", "upper")


def robust_bounds(df: DataFrame, column: str) -> DataFrame:
    """median, mad (raw), mean and std (population), in two passes."""
    x = values(df, column)
    med = quantile_row(df, [x], [0.5]).select(F.get("q0", F.lit(0)).alias("median")).crossJoin(F.broadcast(df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))))
    dev = quantile_row(df.select(x.alias("_x")).crossJoin(F.broadcast(med)), [F.abs(F.col("_x") - F.col("median"))], [0.5])  # one row each
    return med.crossJoin(F.broadcast(dev.select(F.get("q0", F.lit(0)).alias("mad"))))


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0, robust: bool = True) -> DataFrame:
    """Rows whose (robust) z-score is beyond the threshold, with the score and both kinds of bounds.

    ``lower`` and ``upper`` are centre plus or minus threshold times raw deviation, as reports have them;
    ``effective_lower`` and ``effective_upper`` are where the mask cuts. A mad of 0 falls back to (x - median) / std.
    """
    if robust:
        b = robust_bounds(df, column)
        scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.nullif("std", F.lit(0.0)))
        centre, raw = F.col("median"), F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("std"))
    else:
        x = values(df, column)
        b = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
        scale, centre, raw = F.nullif("std", F.lit(0.0)), F.col("mean"), F.col("std")
    z = (F.col("_x") - centre) / scale
    out = _flag(df, column, b, F.abs(z) > threshold)
    return out.select("row.*", z.alias("z"), (centre - threshold * raw).alias("lower"), (centre + threshold * raw).alias("upper"), (centre - threshold * scale).alias("effective_lower"), (centre + threshold * scale).alias("effective_upper"))


def outlier_summary(df: DataFrame, outliers: DataFrame, column: str) -> DataFrame:
    """(n, n_outliers, outlier_rate in percent)."""
    total = df.agg(F.count(values(df, column)).alias("n"))
    found = outliers.agg(F.count("*").alias("n_outliers"))
    return total.crossJoin(F.broadcast(found)).withColumn("outlier_rate", F.round(100 * F.col("n_outliers") / F.greatest("n", F.lit(1)), 2))


def _group_moments(df: DataFrame, target: str, group: str) -> DataFrame:
    x = values(df, target)
    return df.where(x.isNotNull() & F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def anova(df: DataFrame, target: str, group: str) -> DataFrame:
    """One row: n, k, f, eta2 and omega2 of a one-way analysis of variance, from one row for each group."""
    g = _group_moments(df, target, group)
    grand = g.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.count("*").alias("k"))
    s = g.crossJoin(F.broadcast(grand)).agg(F.max("total").alias("n"), F.max("k").alias("k"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), F.lit(2))).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw"))
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    msw = F.try_divide("ssw", dfw)
    return s.select("n", "k", "ssb", "ssw", F.try_divide(F.try_divide("ssb", dfb), msw).alias("f"), F.try_divide("ssb", F.col("ssb") + F.col("ssw")).alias("eta2"), F.greatest(F.lit(0.0), F.try_divide(F.col("ssb") - dfb * msw, F.col("ssb") + F.col("ssw") + msw)).alias("omega2"))


def variance_impact(df: DataFrame, target: str, group: str, alpha: float = 0.05) -> dict:
    """ANOVA with its p-value and effect label; fewer than two groups are an error."""
    r = anova(df, target, group).first().asDict()
    if (r["k"] or 0) < 2:
        raise ValueError("at least two groups are needed")
    p = S.f_sf(r["f"], r["k"] - 1, r["n"] - r["k"]) if r["f"] is not None else 0.0
    e = r["eta2"] or 0.0
    label = "negligible" if e < 0.01 else "small" if e < 0.06 else "medium" if e < 0.14 else "large"
    return r | {"p_value": p, "significant": p < alpha, "effect": label}


def average_rank(x: Column, within: tuple[str, ...] = ()) -> Column:
    """Ranks from 1, ties averaged. Without ``within`` one task ranks all rows; use ``ranked`` for large data."""
    return F.rank().over(Window.partitionBy(*within).orderBy(x)) + (F.count("*").over(Window.partitionBy(*within, x)) - 1) / 2


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``_rank_<i>`` for each column, by distributed ranking.

    Counts of distinct values are sorted by range over all tasks; each partition's
    total shifts the ranks of the next, so only one number for each partition is
    gathered. Ranks are joined back by value.
    """
    for i, c in enumerate(columns):
        counts = df.groupBy(F.col(f"`{c}`").alias("_v")).agg(F.count("*").alias("_k"))
        df = df.join(distributed_ranks(counts).withColumnRenamed("_rank", f"_rank_{i}"), F.col(f"`{c}`") == F.col("_v")).drop("_v")
    return df


def distributed_ranks(counts: DataFrame) -> DataFrame:
    """(_v, _rank) from (_v, _k): average ranks of values that occur _k times, ordered by value."""
    # written once: range bounds come from a sample, so a second evaluation could cut elsewhere
    parts = materialize(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "ranks")
    inside = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_to", F.sum("_k").over(inside))
    totals = local.groupBy("_p").agg(F.max("_to").alias("_n"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return local.join(F.broadcast(before.select("_p", "_base")), "_p").select("_v", (F.col("_base") + F.col("_to") - (F.col("_k") - 1) / 2).alias("_rank"))


def correlation_pairs(df: DataFrame, max_cols: int = 8, top: int = 10, min_rows: int = 5) -> DataFrame:
    """(col_a, col_b, n, pearson, spearman, strength) of the first numeric columns, complete rows only, strongest first."""
    from plumbline.operators.profile import numeric_columns

    columns = numeric_columns(df)[:max_cols]
    xs = [values(df, c) for c in columns]
    complete = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    r = ranked(complete, [f"x{i}" for i in range(len(columns))])
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n long, pearson double, spearman double, strength string")
    row = r.agg(F.count("*").alias("n"), *[x for i, j in pairs for x in (corr(f"x{i}", f"x{j}").alias(f"p_{i}_{j}"), corr(f"_rank_{i}", f"_rank_{j}").alias(f"s_{i}_{j}"))])
    long = row.select("n", F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("col_a"), F.lit(columns[j]).alias("col_b"), F.col(f"p_{i}_{j}").alias("pearson"), F.col(f"s_{i}_{j}").alias("spearman")) for i, j in pairs])).alias("x"))
    out = long.where(F.col("n") >= min_rows).select("x.col_a", "x.col_b", "n", F.round("x.pearson", 6).alias("pearson"), F.round("x.spearman", 6).alias("spearman"))
    return out.withColumn("strength", N.corr_label(F.coalesce("pearson", F.lit(0.0)))).orderBy(F.desc(F.abs("pearson")), "col_a", "col_b").limit(top)


def correlation_matrix(df: DataFrame, **options) -> list[dict]:
    """``correlation_pairs`` with p-values (at most ``top`` rows)."""
    out = []
    for r in correlation_pairs(df, **options).collect():
        d = r.asDict()
        p = S.correlation_p(d["pearson"] or 0.0, d["n"])
        out.append(d | {"pearson_p": p, "spearman_p": S.correlation_p(d["spearman"] or 0.0, d["n"]), "significant": p < 0.05 and math.isfinite(p)})
    return out
