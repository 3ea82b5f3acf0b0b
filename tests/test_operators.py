import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomaly, audit, edits, hypothesis, impute, impute_mv, match, profile, quantiles


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_profile_of_odd_columns(spark):
    df = frame(spark, [(i, float("nan") if i == 3 else 5.0, None, "1" if i % 2 else "x", True) for i in range(12)], "i int, d double, n string, s string, b boolean")
    p = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert p["d"]["miss_pct"] == round(100 / 12, 4) and p["d"]["skew"] is None and p["d"]["n_unique"] == 1
    assert p["n"]["health"] == "missing" and p["s"]["type_mismatch_pct"] == 50.0 and p["b"]["mean"] == 1.0
    assert profile.missing_summary(df).where("column = 'n'").first()["missing_count"] == 12
    s = one(profile.trust_score(df))
    assert 0 <= s["score"] <= 100 and s["p_type"] == round(1.0 / 5, 4)
    assert profile.column_penalties(df).first()["column"] == "n"


def test_duplicates_and_dedup(spark):
    df = frame(spark, [(1, None, "a"), (2, None, "a"), (3, 1, "a"), (4, None, "b")], "id int, k int, s string")
    assert one(profile.duplicate_count(df.drop("id"))) == {"n_rows": 4, "n_distinct": 3, "n_duplicates": 1}
    assert sorted(r["id"] for r in profile.dedup_first(df, ["k", "s"], ["id"]).collect()) == [1, 3, 4]


def test_empty_frames(spark):
    df = frame(spark, [], "x double, s string")
    assert profile.quality_score(df).count() == 1 and profile.duplicate_count(df).first()["n_rows"] == 0
    assert impute.missing_pattern(df).count() == 0
    assert audit.iqr_outliers(df, "x").count() == 0 and audit.histogram(df, "x").count() == 0


def test_outlier_edges(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, None, 100.0])], "_rid long, v double")
    assert [r["_rid"] for r in audit.iqr_outliers(df, "v").collect()] == [6]
    assert [r["_rid"] for r in audit.zscore_outliers(df, "v").collect()] == [6]
    flat = frame(spark, [(i, 1.0) for i in range(9)] + [(9, 50.0)], "_rid long, v double")
    assert audit.zscore_outliers(flat, "v", 2.5).count() == 1  # mad of 0 falls back to the deviation
    same = frame(spark, [(i, 1.0) for i in range(9)], "_rid long, v double")
    assert audit.zscore_outliers(same, "v").count() == 0 and audit.zscore_outliers(same, "v", robust=False).count() == 0
    h = audit.histogram(same, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0, 0, 9, 0] and h[0]["lo"] == 0.5


def test_benford(spark):
    good = frame(spark, [(2.0**i,) for i in range(400)], "v double")
    assert not audit.benford(good, "v")["suspicious"]
    bad = frame(spark, [(float(1 + i % 9),) for i in range(400)] + [(-1.0,), (0.0,), (None,)], "v double")
    r = audit.benford(bad, "v")
    assert r["suspicious"] and r["n"] == 400 and r["conformity"] == "Nonconformity" and r["p_value"] < 1e-6
    with pytest.raises(ValueError):
        audit.benford(bad.limit(10), "v")


def test_normality_and_notes(spark):
    rnd = random.Random(1)
    small = frame(spark, [(rnd.gauss(0, 1),) for _ in range(300)], "v double")
    r = audit.normality(small, "v")
    assert r["test"] == "Shapiro-Wilk" and r["is_normal"]
    big = frame(spark, [(rnd.expovariate(1),) for _ in range(6000)], "v double")
    r = audit.normality(big, "v")
    assert r["test"].startswith("D'Agostino") and not r["is_normal"] and r["alpha"] == 0.001
    assert math.isclose(audit.normality_moments(big, "v").first()["k2"], r["statistic"], rel_tol=1e-6)
    assert "z-score" in audit.expert_note(True, 0.1, 0, 100)


def test_distributed_ranks(spark):
    rnd = random.Random(2)
    v = [rnd.randint(0, 20) for _ in range(200)]
    got = {r["_v"]: r["_rank"] for r in audit.distributed_ranks(frame(spark, [(x,) for x in v], "x int").groupBy(F.col("x").alias("_v")).agg(F.count("*").alias("_k"))).collect()}
    s = sorted(v)
    assert all(got[x] == sum(i + 1 for i, y in enumerate(s) if y == x) / s.count(x) for x in set(v))


def test_hypothesis_choices(spark):
    rnd = random.Random(3)
    rows = [(float(i), 2.0 * i + rnd.gauss(0, 3), "ab"[i % 2], "xyz"[i % 3], rnd.gauss(10 * (i % 2), 1), rnd.gauss(0, 1 + 5 * (i % 2)), "pq"[i % 2], rnd.expovariate(1) ** 3) for i in range(240)]
    df = frame(spark, rows, "i double, j double, g string, h string, a double, b double, g2 string, e double")
    r = hypothesis.test(df, "i", "j")
    assert r["test"] in ("pearson", "spearman") and r["significant"] and r["effect_label"] == "very strong"
    assert hypothesis.test(df, "a", "g")["test"] == "student_t"
    assert hypothesis.test(df, "b", "g")["test"] == "welch_t"
    assert hypothesis.test(df, "a", "h")["test"] in ("anova", "kruskal")
    assert hypothesis.test(df, "g", "g2")["test"] == "chi_square"
    few = df.limit(24).withColumn("e", F.col("e") * 100)
    assert hypothesis.test(few, "e", "g")["test"] in ("mann_whitney", "student_t", "welch_t")
    small = frame(spark, [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 1 + [("b", "y")] * 5, "x string, y string")
    f = hypothesis.test(small, "x", "y")
    assert f["test"] == "fisher" and math.isclose(f["p_value"], 0.03496503496503495, rel_tol=1e-9)
    many = hypothesis.test_multiple(df, "g", ["a", "b", "h"])
    assert [m["p_value"] for m in many] == sorted(m["p_value"] for m in many) and many[0]["feature"] == "a"


def test_types(spark):
    rows = [(i % 2, i % 20, i % 21, "u", float(i)) for i in range(1000)]
    df = frame(spark, rows, "two int, twenty int, more int, one string, all double")
    assert [hypothesis.infer_type(df, c) for c in df.columns] == ["binary", "categorical", "continuous", "categorical", "continuous"]


def test_kernels():
    assert match.indel_ratio("kitten", "sitting") == 200 * 4 / 13 and match.indel_ratio("", "") == 100
    assert math.isclose(match.jaro("MARTHA", "MARHTA"), 94.4444444444) and math.isclose(match.jaro_winkler("MARTHA", "MARHTA"), 96.1111111111)
    assert match.jaro("abc", "", "reference") == 0 and match.jaro("x", "x") == 100
    rnd = random.Random(4)
    from collections import Counter

    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in "ab")
        for name, k in match.KERNELS.items():
            for v in ("standard", "reference"):
                assert 0 <= k(a, b, v) <= 100 + 1e-9 and match._bound(name, a, b, Counter(a), Counter(b)) >= k(a, b, v) - 1e-9
                assert k(a, a, v) == 100


def test_match_edges(spark):
    p = frame(spark, [(1, "Ali Veli"), (2, None), (3, ""), (4, "zzzz"), (5, "ALİ  VELİ")], "_rid long, name string")
    s = frame(spark, [(10, "ali veli"), (11, "ali veli"), (12, "veli ali"), (13, None)], "_rid long, name string")
    m = {r["rid_p"]: r for r in match.best_matches(p, s, "name", block=1).collect()}
    assert set(m) == {1, 5} and m[1]["rid_s"] == 10 and m[1]["score"] == 100
    assert sorted(r["_rid"] for r in match.unmatched(p, match.best_matches(p, s, "name"), "p").collect()) == [2, 3, 4]
    merged = match.merge(p, s.withColumn("x", F.lit(1)), match.best_matches(p, s, "name"))
    assert merged.columns == ["_match_score", "_match_status", "_rid_p", "name_p", "_rid_s", "name_s", "x"]
    t = match.best_matches(p, s, "name", algorithm="token_sort").collect()
    assert {r["rid_s"] for r in t} == {10}


def test_fills(spark):
    df = frame(spark, [(i, "ab"[i % 2], v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "r long, k string, v double")
    get = lambda m, **kw: [x["v"] for x in impute.fill(df, "v", m, order="r", **kw).orderBy("r").collect()]
    assert get("ffill") == [None, 1, 1, 1, 4, 4] and get("bfill") == [1, 1, 4, 4, 4, None] and get("interpolate") == [1, 1, 2, 3, 4, 4]
    assert get("ffill", by=["k"]) == [None, 1, None, 1, 4, 1]
    assert get("mean") == [2.5, 1, 2.5, 2.5, 4, 2.5] and get("mode") == [1, 1, 1, 1, 4, 1] and get("constant", constant=9.0)[0] == 9
    rep = one(impute.fill_report(df, impute.fill(df, "v", "ffill", order="r"), "v"))
    assert (rep["missing_before"], rep["missing_after"], rep["cells_filled"]) == (4, 1, 3)


def test_penalty_identity(spark):
    df = frame(spark, [(float(i % 17),) for i in range(200)], "v double")
    p = one(impute.penalty(df, df, "v"))
    assert p["penalty"] == 0 and p["grade"] == "A" and not p["variance_warning"]
    shifted = df.select((F.col("v") + 100).alias("v"))
    p = one(impute.penalty(df, shifted, "v"))
    assert p["ks"] == 1 and p["wasserstein"] == 100 and p["penalty"] == 0.8


def test_multivariate_imputation(spark):
    rnd = random.Random(5)
    rows = [(i, x := rnd.uniform(0, 10), None if i % 10 == 0 else 3 * x + 1, "c") for i in range(300)]
    df = frame(spark, rows, "id int, x double, y double, s string")
    truth = {r[0]: 3 * r[1] + 1 for r in rows}
    assert impute_mv.predictors(df, ["y"]) == ["x", "y"]
    for method, most in (("mice", 1e-3), ("knn", 1.5)):
        out, report = impute_mv.impute(df, method)
        assert max(abs(r["y"] - truth[r["id"]]) for r in out.collect()) < most and report["n_filled"] == 30
    with pytest.raises(ValueError):
        impute_mv.impute(df.select("x"), "mice")


def test_anomalies(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(5, 1), rnd.gauss(-2, 1)) for i in range(300)] + [(1000, 15.0, 30.0, -2.0), (1001, -14.0, 5.0, 20.0)] + [(1002, None, 5.0, -2.0)]
    df = frame(spark, rows, "id long, a double, b double, c double")
    f = anomaly.isolation_forest(df, ["a", "b", "c"], contamination=0.02).where("_is_anomaly").collect()
    assert {1000, 1001} <= {r["id"] for r in f} and all(-1 <= r["_score"] <= 0 for r in f)
    top = {r["id"]: r["t"][0]["feature"] for r in anomaly.isolation_forest(df, ["a", "b", "c"], contamination=0.02).where("_is_anomaly").select("id", anomaly.top_features(F.col("_contributions")).alias("t")).collect()}
    assert top[1001] in ("a", "c")
    both = anomaly.detect(df, "id", ["a", "b", "c"], algorithm="ensemble", contamination=0.02).where("_is_anomaly").collect()
    assert {1000, 1001} <= {r["id"] for r in both}
    tied = frame(spark, [(i, float(i % 7), float(i % 5)) for i in range(90)] + [(500, 40.0, 40.0)], "id long, a double, b double")
    one, many = ({r["id"]: round(r["_lof"], 9) for r in anomaly.local_outlier_factor(tied, "id", ["a", "b"], k=6, block=b).collect()} for b in (1000, 13))
    assert one == many and max(one, key=one.get) == 500
    assert anomaly.choose("ensemble", 1000, 20) == ["isolation_forest"]


def test_edits(spark):
    df = frame(spark, [(1, "a", None), (2, None, 3.0), (3, "c", 1.0)], "id int, s string, v double")
    assert [r["id"] for r in edits.drop_rows(df, "v > 2").collect()] == [1, 3]
    assert [r["id"] for r in edits.sort_rows(df, ["v"], ascending=False).collect()] == [2, 3, 1]
    assert [r["id"] for r in edits.drop_by_id(df, [1, 99], "id").collect()] == [2, 3]
    assert [r["r"] for r in edits.with_rid(df, "v", "r").orderBy("r").collect()] == [0, 1, 2]
    assert edits.cast_column(df, "s", "numeric").schema["s"].dataType.typeName() == "double"
    a, b = edits.frame_hash(df).first(), edits.frame_hash(df.orderBy(F.desc("id"))).first()
    assert a == b


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = [(i, float((i * 7919) % 1000), "abc"[i % 3]) for i in range(500)]
    df = frame(spark, rows, "id long, v double, g string").repartition(parts)
    assert one(audit.anova(df, "v", "g"))["n"] == 500
    assert one(hypothesis.kruskal(df, "v", "g")) == one(hypothesis.kruskal(df.coalesce(1), "v", "g"))
    assert one(audit.describe(df, "v")) == one(audit.describe(df.coalesce(1), "v"))


def test_knn_compares_with_all_rows_in_blocks(spark):
    rnd = random.Random(3)
    some = lambda v, p: None if rnd.random() < p else v
    rows = [(some(rnd.gauss(0, 3), 0.1), some(rnd.uniform(0, 9), 0.1), some(rnd.random(), 0.3)) for _ in range(300)] + [(None, None, None)]
    x = np.array(rows, dtype=float)
    low, mid, high = np.nanpercentile(x, [25, 50, 75], axis=0)
    z = (x - mid) / (high - low)
    want = {}
    for i, r in enumerate(z):
        near = sorted((np.sqrt(3 / m.sum() * ((d - r)[m] ** 2).sum()), d[2]) for d in z if (m := ~np.isnan(d) & ~np.isnan(r)).any() and not np.isnan(d[2]))[:5]
        v = sum(t / d for d, t in near) / sum(1 / d for d, _ in near) if near and near[0][0] else 0.0
        want[str(i)] = v * (high - low)[2] + mid[2] if np.isnan(r[2]) else rows[i][2]
    df = frame(spark, [(str(i), *r) for i, r in enumerate(rows)], "id string, a double, b double, t double")
    for values in (400, 4000):
        got = impute_mv.knn(df, ["t"], block_values=values)
        assert got.columns == df.columns
        assert {r["id"]: r["t"] for r in got.collect()} == pytest.approx(want)


def test_knn_finds_the_one_near_row_of_many(spark):
    df = spark.range(60_000).select((F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 1000 != 500, F.col("id") * 2.0).alias("t"))
    got = impute_mv.knn(df, ["t"], k=2).where("a % 1000 = 500").collect()
    assert len(got) == 60 and all(abs(r["t"] - 2 * r["a"]) < 1e-6 for r in got)


CLASH = "_rank int, _p int, _v double, _i int, _m string, _prev int, _next int, _x int, k0 int, o0 int, row int, _before int, _after int, place int, `key` int, lower int"


def test_names_that_clash(spark):
    rows = [(i % 3, i, None if i % 4 == 0 else float(i), i, "a" if i % 5 else None, i, i, i, i, i, i, i, i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, CLASH)
    first = profile.dedup_first(df, ["_rank"], ["_i"])
    assert first.columns == df.columns and sorted(r["_i"] for r in first.collect()) == [0, 1, 2]
    for method in ("ffill", "bfill", "interpolate"):
        for by in (None, ["_rank"]):
            out = impute.fill(df, "_v", method, order="_i", by=by)
            assert out.columns == df.columns and [r["_p"] for r in out.orderBy("_i").collect()] == list(range(40))
    for method in ("mean", "median", "mode"):
        out = impute.fill(df, "_m" if method == "mode" else "_v", method)
        assert out.columns == df.columns and out.where("_v is null and _m is null").count() == 0
    assert audit.iqr_outliers(df, "_p").columns[: len(df.columns)] == df.columns


def test_dedup_keeps_types_and_nulls(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, None, "a"), (1, 5, None), (1, 4, "c")], "k int, o int, v string")
    assert sorted((str(r["k"]), r["v"]) for r in profile.dedup_first(df, ["k"], ["o"]).collect()) == [("1", "c"), ("None", "a")]


def test_quantiles_by_either_path(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1.0, 2.5, float(rnd.randint(0, 40))]), float(i), None) for i in range(501)]
    df = frame(spark, rows, "a double, b double, c double")
    xs, probs = [F.col("a"), F.col("b"), F.col("c")], [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    one, many = quantiles.quantile_row(df, xs, probs).first(), quantiles.quantile_row(df, xs, probs, one_buffer=0).first()
    for x, y in zip(one, many):
        assert x == y or np.allclose(x, y, rtol=1e-12)
    assert many["q2"] is None and quantiles.quantile_row(df.limit(0), xs, probs, one_buffer=0).first() == (None, None, None)
