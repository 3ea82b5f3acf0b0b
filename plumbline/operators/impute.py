"""Missing-data analysis and univariate imputation, fills by row order, and distribution damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from plumbline.functions import numbers as N
from plumbline.operators.profile import present, wide_to_long

METHODS = ("mean", "median", "mode", "constant", "ffill", "bfill", "interpolate")
DEFAULT_TEXT = "Bilinmiyor"


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (NumericType, BooleanType))


def missing_pattern(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct, max_corr, pattern, recommended): NONE, MCAR, MAR or MNAR from correlated null flags.

    One aggregation holds all pairs of flags of columns; a row for each column comes out.
    """
    cols = df.columns
    flag = [present(df, c).isNull().cast("double") for c in cols]
    flags = df.select(*[f.alias(f"f{i}") for i, f in enumerate(flag)], *[(N.clean(F.col(f"`{c}`").cast("double")) if _numeric(df, c) else F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    aggs = []
    for i in range(len(cols)):
        others = [F.abs(F.coalesce(corr(f"f{i}", f"f{j}"), F.lit(0.0))) for j in range(len(cols)) if j != i]
        most = F.greatest(F.lit(0.0), *others) if others else F.lit(0.0)
        aggs += [F.count("*").alias(f"n_{i}"), F.coalesce(F.sum(f"f{i}"), F.lit(0.0)).alias(f"miss_{i}"), most.alias(f"corr_{i}"), F.count(f"x{i}").alias(f"k_{i}"), F.skewness(f"x{i}").alias(f"skew_{i}")]
    kinds = {c: "temporal" if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else "numeric" if _numeric(df, c) else "text" for c, f in zip(cols, df.schema.fields)}
    long = wide_to_long(flags.agg(*aggs), cols, {"n": "long", "miss": "long", "corr": "double", "k": "long", "skew": "double"}).where("n > 0")
    kind = F.element_at(F.create_map(*[F.lit(v) for p in kinds.items() for v in p]), F.col("column"))
    pct = F.round(100 * F.col("miss") / F.col("n"), 2)
    pattern = F.when(F.col("miss") == 0, "NONE").when(pct > 40, "MNAR").when(F.col("corr") >= 0.2, "MAR").otherwise("MCAR")
    k = F.col("k").cast("double")
    skew = F.when(k > 2, F.col("skew") * F.sqrt(k * (k - 1)) / (k - 2))
    method = (
        F.when(F.col("miss") == 0, "mean").when(kind == "temporal", "ffill")
        .when(kind == "text", F.when((pct > 30) | (pattern == "MNAR"), "constant").otherwise("mode"))
        .when((pct > 40) | (pattern == "MNAR"), "median").when(F.abs(skew) < 0.5, "mean").otherwise("median")
    )
    return long.select("column", F.col("miss").alias("missing_count"), pct.alias("missing_pct"), F.round("corr", 6).alias("max_corr"), pattern.alias("pattern"), method.alias("recommended"))


def alternatives(df: DataFrame, column: str, method: str) -> list[str]:
    """Up to two other sensible methods."""
    pool = ["mean", "median", "interpolate"] if _numeric(df, column) else ["mode", "constant", "ffill"]
    return [m for m in pool if m != method][:2]


def ffill(x: Column, order: list[Column], by: list[str] = ()) -> Column:
    """The last value before a gap; leading nulls stay. Without ``by`` one task walks the whole table."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: Column, order: list[Column], by: list[str] = ()) -> Column:
    return F.first(x, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def fill_by_order(df: DataFrame, column: str, order: str, method: str, by: list[str] | None = None) -> DataFrame:
    """ffill, bfill or interpolate (by row position, edges take the nearest value) along ``order``, unique within ``by``.

    Without ``by`` the table is cut by range of ``order`` into partitions that are filled
    on their own; only each partition's first and last values travel, so no task holds the table.
    """
    c = F.col(f"`{column}`")
    if method == "interpolate" and not _numeric(df, column):
        method = "ffill"
    o = F.col("row").getField(order)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # so that no name of the table clashes
    if by:
        rows, keys = df.select(whole, present(df, column).alias("_v")), [F.col("row").getField(b) for b in by]
        before = after = F.lit(None)
    else:
        from plumbline.runtime import materialize

        rows = materialize(df.repartitionByRange(F.col(f"`{order}`")).select(whole, present(df, column).alias("_v"), F.spark_partition_id().alias("_p")), "fill")
        keys = [F.col("_p")]
    w = Window.partitionBy(*keys).orderBy(o)
    rows = rows.withColumn("_i", F.row_number().over(w).cast("long"))
    if not by:
        ends = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.max(F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))).alias("_last"), F.min(F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))).alias("_first"))
        p = Window.orderBy("_p")  # a row for each partition
        ends = ends.withColumn("_base", F.coalesce(F.sum("_n").over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = lambda s: F.when(s.isNotNull(), F.struct((s["_i"] + F.col("_base")).alias("_i"), s["_v"].alias("_v")))
        ends = ends.withColumn("_before", F.last(place(F.col("_last")), True).over(p.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.last(place(F.col("_first")), True).over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.join(F.broadcast(ends.select("_p", "_base", "_before", "_after")), "_p").withColumn("_i", F.col("_i") + F.col("_base"))
        before, after = F.col("_before"), F.col("_after")
    here = F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))
    prev = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("_i"))  # Spark walks a frame to the end anew for each row
    nxt = F.last(here, True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_prev", prev if by else F.coalesce(prev, before)).withColumn("_next", nxt if by else F.coalesce(nxt, after))
    pv, nv = F.col("_prev._v"), F.col("_next._v")
    if method == "ffill":
        new = pv
    elif method == "bfill":
        new = nv
    elif method == "interpolate":
        step = F.try_divide((nv - pv) * (F.col("_i") - F.col("_prev._i")), F.col("_next._i") - F.col("_prev._i"))
        new = F.coalesce(F.col("_v").cast("double"), pv + step, nv.cast("double"), pv.cast("double"))
    else:
        raise ValueError(f"{method} does not go by order")
    return rows.select(*[(new if x == column else F.col("row").getField(x)).alias(x) for x in df.columns])


def fill(df: DataFrame, column: str, method: str, constant=None, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The table with the column's gaps filled."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    x = present(df, column)
    if method in ("ffill", "bfill", "interpolate"):
        if order is None:
            raise ValueError(f"{method} needs an order column")
        return fill_by_order(df, column, order, method, by)
    if method == "constant":
        value = constant if constant is not None else DEFAULT_TEXT if isinstance(df.schema[column].dataType, StringType) else 0
        return df.withColumn(column, F.coalesce(x, F.lit(value)))
    if method == "mode":
        counts = df.select(x.alias("_m")).where("_m is not null").groupBy("_m").agg(F.count("*").alias("_k"))
        one = counts.agg(F.min(F.struct((-F.col("_k")).alias("k"), "_m"))["_m"].alias("_m"))  # the smallest of the most frequent
    else:
        one = df.agg((F.avg(x) if method == "mean" else F.median(x)).alias("_m"))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), x.alias("_x")).crossJoin(F.broadcast(one))  # one row
    return whole.select(*[(F.coalesce("_x", "_m") if c == column else F.col("row").getField(c)).alias(c) for c in df.columns])


def fill_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(column, missing_before, missing_after, cells_filled)."""
    m = lambda d, n: d.agg(F.count_if(present(d, column).isNull()).alias(n))
    return m(before, "missing_before").crossJoin(F.broadcast(m(after, "missing_after"))).select(F.lit(column).alias("column"), "missing_before", "missing_after", (F.col("missing_before") - F.col("missing_after")).alias("cells_filled"))


def penalty(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: KS distance, Wasserstein distance, variance ratio, penalty and its grade between two versions of a column.

    Both samples become counts of distinct values. Values are cut by range into
    partitions; running shares inside and one total for each partition give the
    distribution functions, so no task sorts all values.
    """
    from plumbline.runtime import materialize

    xs = lambda d: N.clean(F.col(f"`{column}`").cast("double"))
    b = before.select(xs(before).alias("v"), F.lit(1).alias("b"), F.lit(0).alias("a")).dropna()
    a = after.select(xs(after).alias("v"), F.lit(0).alias("b"), F.lit(1).alias("a")).dropna()
    counts = b.unionByName(a).groupBy("v").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    parts = materialize(counts.repartitionByRange("v").withColumn("_p", F.spark_partition_id()), "cdf")
    totals = parts.groupBy("_p").agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"), F.min("v").alias("first"))
    p = Window.orderBy("_p")  # a row for each partition
    past = p.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    totals = totals.select("_p", F.coalesce(F.sum("tb").over(past), F.lit(0)).alias("pb"), F.coalesce(F.sum("ta").over(past), F.lit(0)).alias("pa"), F.sum("tb").over(every).alias("nb"), F.sum("ta").over(every).alias("na"), F.lead("first").over(p).alias("_follow"))
    w = Window.partitionBy("_p").orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("pb") + F.sum("b").over(run)) / F.col("nb") - (F.col("pa") + F.sum("a").over(run)) / F.col("na"))
    cdf = parts.join(F.broadcast(totals), "_p").select(gap.alias("gap"), (F.coalesce(F.lead("v").over(w), F.col("_follow")) - F.col("v")).alias("dx"))
    dist = cdf.agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("dx")), F.lit(0.0)).alias("wasserstein"))
    sd = b.agg(F.var_pop("v").alias("vb"), F.count("*").alias("nb")).crossJoin(F.broadcast(a.agg(F.var_pop("v").alias("va"), F.count("*").alias("na"))))
    row = dist.crossJoin(F.broadcast(sd))
    ratio = F.when(F.col("vb") > 0, F.col("va") / F.col("vb")).otherwise(1.0)
    w1 = F.least(F.lit(1.0), F.col("wasserstein") / (F.sqrt("vb") + 1e-8))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * F.col("ks") + 0.4 * w1 + 0.2 * F.least(F.lit(1.0), F.abs(F.log2(ratio + 1e-8)))))
    return row.where("nb >= 5 and na >= 5").select(F.lit(column).alias("column"), F.round("ks", 6).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"), F.round(ratio, 6).alias("variance_ratio"), F.round(p, 6).alias("penalty"), N.penalty_grade(p).alias("grade"), (F.abs(1 - ratio) > 0.1).alias("variance_warning"))


def overall_grade(grades: list[str]) -> str:
    """The worst grade, or N/A."""
    return max(grades, default="N/A")
