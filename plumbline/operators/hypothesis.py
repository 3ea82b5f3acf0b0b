"""Automatic choice and computation of hypothesis tests.

Every statistic is an aggregation over the two columns (rows with both present); ranks
are distributed. Only group rows and one-row statistics reach the driver, where tail
probabilities are computed. Groups are in order of their key, so signs don't depend on
row order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import special as S
from plumbline.functions.text import is_numeric_field
from plumbline.operators import audit as A

BINARY, CATEGORICAL, CONTINUOUS = "binary", "categorical", "continuous"


def infer_type(df: DataFrame, column: str) -> str:
    """binary up to 2 distinct values; numeric columns with few of them (under 5 % and up to 20) or text: categorical; else continuous."""
    c = F.col(f"`{column}`")
    numeric = is_numeric_field(df.schema[column].dataType)
    r = df.agg(F.count_distinct(c).alias("u"), F.count(c).alias("n")).first()
    u, n = r["u"], max(r["n"], 1)
    if numeric:
        return BINARY if u <= 2 else CATEGORICAL if u / n < 0.05 and u <= 20 else CONTINUOUS
    return BINARY if u == 2 else CATEGORICAL


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, g): numeric x and group g as text, complete rows only."""
    return df.select(A.values(df, x).alias("x"), F.col(f"`{y}`").cast("string").alias("g")).dropna()


def group_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """(g, n, mean, median, std, min, max) of x for each group of y."""
    g = pairs(df, x, y).groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return g.select("g", "n", *[F.round(k, 4).alias(k) for k in ("mean", "median", "std", "min", "max")])


def group_modes(df: DataFrame, x: str, y: str) -> DataFrame:
    """(g, n, top, n_unique) of a categorical x for each group of y; ties by value."""
    both = df.select(F.col(f"`{x}`").cast("string").alias("x"), F.col(f"`{y}`").cast("string").alias("g")).dropna()
    counts = both.groupBy("g", "x").agg(F.count("*").alias("k"))
    return counts.groupBy("g").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "x"))["x"].alias("top"), F.count("*").alias("n_unique"))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, count) of complete rows, long form."""
    return df.select(F.col(f"`{x}`").cast("string").alias("x"), F.col(f"`{y}`").cast("string").alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("count"))


def chi_square(df: DataFrame, x: str, y: str, yates: bool = True) -> DataFrame:
    """One row: n, rows, cols, chi2 (Yates' correction on 2x2), dof, min_expected and Cramer's V."""
    t = crosstab(df, x, y)
    rows, cols = t.groupBy("x").agg(F.sum("count").alias("r")), t.groupBy("y").agg(F.sum("count").alias("c"))
    one = rows.agg(F.sum("r").alias("n"), F.count("*").alias("rows"), F.min("r").alias("low_r"), F.sum(1 / F.col("r")).alias("inv_r"))
    one = one.crossJoin(F.broadcast(cols.agg(F.count("*").alias("cols"), F.min("c").alias("low_c"), F.sum(1 / F.col("c")).alias("inv_c"))))  # one row each
    # cells that don't occur add nothing to the sum of observed^2 / expected = n + chi2, so only those that do are visited
    o, rc = F.col("count").cast("double"), F.col("r").cast("double") * F.col("c")
    cells = t.join(rows, "x").join(cols, "y").crossJoin(F.broadcast(one.select("n")))
    out = cells.agg(F.sum(o * o / rc).alias("s"), F.max(F.abs(o - rc / F.col("n"))).alias("gap")).crossJoin(F.broadcast(one))
    n = F.col("n").cast("double")
    yated = F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), F.lit(2)) * n * F.col("inv_r") * F.col("inv_c")  # in a 2x2 table all cells are equally far from what is expected
    chi2 = F.when((F.col("rows") == 2) & (F.col("cols") == 2) & F.lit(yates), yated).otherwise(F.greatest(n * (F.col("s") - 1), F.lit(0.0)))
    out = out.select("n", "rows", "cols", chi2.alias("chi2"), (F.col("low_r") * F.col("low_c") / n).alias("min_expected"))
    v = F.sqrt(F.try_divide("chi2", F.col("n") * (F.least("rows", "cols") - 1)))
    return out.select("n", "rows", "cols", F.round("chi2", 6).alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), F.round("min_expected", 6).alias("min_expected"), F.round(v, 6).alias("cramers_v"))


def levene(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Levene's W about group medians, as an analysis of variance of absolute deviations."""
    p = pairs(df, x, y)
    med = p.groupBy("g").agg(F.median("x").alias("m"))
    dev = p.join(med, "g").select("g", F.abs(F.col("x") - F.col("m")).alias("d"))  # Spark broadcasts the groups if they are few
    return A.anova(dev, "d", "g").select("n", "k", F.round("f", 6).alias("w"))


def two_groups(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: moments of the two groups (sample deviations), Student's and Welch's t, Welch's degrees of freedom, Cohen's d."""
    g = pairs(df, x, y).groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.variance("x").alias("v"))
    row = g.agg(F.sort_array(F.collect_list(F.struct("g", "n", "m", "v"))).alias("s")).where(F.size("s") == 2)
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    na, nb, va, vb = a["n"], b["n"], a["v"], b["v"]
    diff, pooled = a["m"] - b["m"], ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    se = va / na + vb / nb
    dof = F.try_divide(se * se, F.pow(va / na, F.lit(2)) / (na - 1) + F.pow(vb / nb, F.lit(2)) / (nb - 1))
    cols = {
        "t_student": F.try_divide(diff, F.sqrt(pooled * (1 / na + 1 / nb))), "t_welch": F.try_divide(diff, F.sqrt(se)),
        "dof_welch": F.coalesce(dof, (na + nb - 2).cast("double")), "cohen_d": F.coalesce(F.try_divide(diff, F.sqrt((va + vb) / 2)), F.lit(0.0)),
    }
    return row.select(a["g"].alias("group_a"), b["g"].alias("group_b"), na.alias("n_a"), nb.alias("n_b"), *[F.round(v, 6).alias(k) for k, v in cols.items()])


def _rank_groups(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(g, n, r) rank sums of groups, and (N, t): all rows and the tie term, from counts of distinct values."""
    p = pairs(df, x, y)
    cells = p.groupBy("x", "g").agg(F.count("*").alias("k"))
    counts = cells.groupBy(F.col("x").alias("_v")).agg(F.sum("k").alias("_k"))
    ranks = A.distributed_ranks(counts)
    sums = cells.join(ranks, F.col("x") == F.col("_v")).groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("_rank")).alias("r"))
    k = F.col("_k").cast("double")
    return sums, counts.agg(F.sum("_k").alias("N"), F.sum(k * k * k - k).alias("t"))


def kruskal(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, k, tie-corrected H and epsilon squared."""
    sums, ties = _rank_groups(df, x, y)
    row = sums.agg(F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).crossJoin(F.broadcast(ties))
    n = F.col("N").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n))
    return row.select(F.col("N").alias("n"), "k", F.round(h, 4).alias("h"), F.round(F.try_divide(h - F.col("k") + 1, n - F.col("k")), 6).alias("epsilon2"))


def mann_whitney(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: U of the first group, group sizes, the tie term and the rank-biserial correlation."""
    sums, ties = _rank_groups(df, x, y)
    row = sums.agg(F.sort_array(F.collect_list(F.struct("g", "n", "r"))).alias("s")).where(F.size("s") == 2).crossJoin(F.broadcast(ties))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    u = a["r"] - a["n"] * (a["n"] + 1) / 2
    return row.select(a["g"].alias("group_a"), b["g"].alias("group_b"), a["n"].alias("n_a"), b["n"].alias("n_b"), u.cast("double").alias("u"), F.col("t").alias("ties"), F.round(1 - 2 * u / (a["n"] * b["n"]), 6).alias("rank_biserial"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson's r and Spearman's rho of complete rows."""
    both = df.select(A.values(df, x).alias("a"), A.values(df, y).alias("b")).dropna()
    r = A.ranked(both, ["a", "b"])
    corr = lambda p, q: F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q))
    return r.agg(F.count("*").alias("n"), F.round(corr("a", "b"), 6).alias("pearson"), F.round(corr("_rank_0", "_rank_1"), 6).alias("spearman"))


def _label(value: float, cuts: tuple[float, ...], names: tuple[str, ...]) -> str:
    return next((n for c, n in zip(cuts, names) if value < c), names[-1])


_D = ((0.2, 0.5, 0.8), ("negligible", "small", "medium", "large"))
_R = ((0.1, 0.3, 0.5), ("negligible", "small", "medium", "large"))
_ETA = ((0.01, 0.06, 0.14), ("negligible", "small", "medium", "large"))
_CORR = ((0.1, 0.3, 0.5, 0.7), ("negligible", "weak", "moderate", "strong", "very strong"))
_V = ((0.1, 0.3), ("weak", "moderate", "strong"))


def _normal(df: DataFrame, column: str) -> bool:
    n = df.agg(F.count(A.values(df, column))).first()[0]
    return n < 3 or A.normality(df, column, alpha_large=None)["is_normal"]


def _result(test: str, path: list[str], stat: float, p: float, effect: float, label: str, n: int, alpha: float, **more) -> dict:
    sig = p < alpha
    verdict = f"{test}: statistic {stat:.4f}, p {p:.6f}; " + ("a significant result" if sig else "no significant result") + f" at {alpha}. Effect {label} ({effect:.4f})."
    return {"test": test, "decision_path": path, "statistic": stat, "p_value": p, "effect_size": effect, "effect_label": label, "n": n, "significant": sig, "verdict": verdict, "recommendation": recommendation(test, sig, effect, label), **more}


def recommendation(test: str, significant: bool, effect: float, label: str) -> str:
    """What to do next, in words."""
    if test in ("pearson", "spearman"):
        if not significant:
            return "No statistical relation; look at other factors."
        return "Strong relation: consider regression." if effect > 0.5 else "Moderate relation: use as a control variable." if effect > 0.3 else "Weak relation: of limited practical use."
    if not significant:
        return "Groups do not differ; reconsider the grouping."
    return "Use post-hoc comparisons to find the groups that differ." if test in ("anova", "kruskal") else f"The groups differ; the effect is {label}."


def test(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> dict:
    """Chooses and runs a test for two columns."""
    tx, ty = infer_type(df, x), infer_type(df, y)
    types = {x: tx, y: ty}
    if tx == CONTINUOUS and ty == CONTINUOUS:
        return _correlation_test(df, x, y, alpha) | {"types": types}
    if CONTINUOUS in (tx, ty):
        cont, cat = (x, y) if tx == CONTINUOUS else (y, x)
        return _group_test(df, cont, cat, alpha) | {"types": types}
    return _contingency_test(df, x, y, alpha) | {"types": types}


def _correlation_test(df: DataFrame, x: str, y: str, alpha: float) -> dict:
    both = df.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull())
    r = correlation(both, x, y).first()
    parametric = r["n"] >= 30 and _normal(both, x) and _normal(both, y)
    name = "pearson" if parametric else "spearman"
    v = r[name] or 0.0
    return _result(name, ["continuous x continuous", "normal" if parametric else "not normal or small"], v, S.correlation_p(v, r["n"]), abs(v), _label(abs(v), *_CORR), r["n"], alpha, direction="positive" if v >= 0 else "negative")


def _group_test(df: DataFrame, cont: str, cat: str, alpha: float) -> dict:
    p = pairs(df, cont, cat)
    sizes = {r["g"]: r["n"] for r in p.groupBy("g").agg(F.count("*").alias("n")).where("n >= 3").collect()}  # a row for each group
    if len(sizes) < 2:
        raise ValueError("at least two groups of three values are needed")
    p = p.where(F.col("g").isin(*sizes))
    parametric = min(sizes.values()) >= 30 or all(_normal(p.where(F.col("g") == k), "x") for k in sizes)
    n, k = sum(sizes.values()), len(sizes)
    w = levene(p, "x", "g").first()
    equal = w["w"] is None or S.f_sf(w["w"], k - 1, n - k) > alpha
    path = [f"{k} groups", "parametric" if parametric else "not parametric", "equal variances" if equal else "unequal variances"]
    if k == 2 and parametric:
        r = two_groups(p, "x", "g").first()
        t, dof = (r["t_student"], n - 2) if equal else (r["t_welch"], r["dof_welch"])
        d = abs(r["cohen_d"])
        return _result("student_t" if equal else "welch_t", path, t or 0.0, S.t_two_sided(t or 0.0, dof), d, _label(d, *_D), n, alpha)
    if k == 2:
        r = mann_whitney(p, "x", "g").first()
        e = abs(r["rank_biserial"])
        return _result("mann_whitney", path, r["u"], S.mann_whitney_p(r["u"], r["n_a"], r["n_b"], r["ties"]), e, _label(e, *_R), n, alpha)
    if parametric and equal:
        r = A.anova(p, "x", "g").first()
        return _result("anova", path, r["f"] or 0.0, S.f_sf(r["f"] or 0.0, k - 1, n - k), r["eta2"] or 0.0, _label(r["eta2"] or 0.0, *_ETA), n, alpha)
    r = kruskal(p, "x", "g").first()
    e = max(0.0, r["epsilon2"] or 0.0)
    return _result("kruskal", path, r["h"] or 0.0, S.chi2_sf(r["h"] or 0.0, k - 1), e, _label(e, *_ETA), n, alpha)


def _contingency_test(df: DataFrame, x: str, y: str, alpha: float) -> dict:
    r = chi_square(df, x, y).first()
    if r["rows"] == 2 and r["cols"] == 2 and r["min_expected"] < 5:
        cells = {(c["x"], c["y"]): c["count"] for c in crosstab(df, x, y).collect()}  # four cells
        xs, ys = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
        a, b, c, d = (cells.get((i, j), 0) for i in xs for j in ys)
        odds, p = S.fisher_exact(a, b, c, d)
        effect = abs(math.log(odds)) if odds > 0 and not math.isnan(odds) else 0.0
        return _result("fisher", ["2x2", "expected below 5"], odds, p, effect, _label(effect, *_D), r["n"], alpha)
    p = S.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0
    return _result("chi_square", [f"{r['rows']}x{r['cols']}"], r["chi2"], p, r["cramers_v"] or 0.0, _label(r["cramers_v"] or 0.0, *_V), r["n"], alpha)


def test_multiple(df: DataFrame, target: str, features: list[str], alpha: float = 0.05) -> list[dict]:
    """Tests of the target against each feature, by p-value; features whose test is impossible are left out."""
    out = []
    for f in features:
        try:
            out.append(test(df, f, target, alpha) | {"feature": f})
        except ValueError:
            continue
    return sorted(out, key=lambda r: (r["p_value"], r["feature"]))
