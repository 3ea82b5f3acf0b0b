import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import i18n
from plumbline.functions import numbers as N
from plumbline.functions import special as S
from plumbline.functions import text as T


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    return [r["r"] for r in df.select("i", fn(F.col("s")).alias("r")).orderBy("i").collect()]


def test_turkish_case(spark):
    assert apply(spark, T.tr_lower, ["IİĞ ABC", None, ""]) == ["ıiğ abc", None, ""]
    assert apply(spark, T.tr_upper, ["ıiğ ß", None]) == ["IİĞ SS", None]
    assert apply(spark, T.tr_title, ["iSTANBUL  ıĞDIR o'NEIL ", None]) == ["İstanbul Iğdır O'neıl", None]


def test_white_space_and_unicode(spark):
    assert apply(spark, T.normalize_whitespace, ["  a  \x1c b\t", None]) == ["a b", None]
    assert apply(spark, T.normalize_unicode, ["é", "plain", None]) == ["é", "plain", None]


def test_mojibake(spark):
    assert apply(spark, T.fix_mojibake, ["gÃ¼l", "Å\x9feker", "gül", "漢字", None]) == ["gül", "şeker", "gül", "漢字", None]


def test_dates(spark):
    got = apply(spark, T.normalize_date, ["1.2.2020", "31/13/2020", "2020-1-2", "01.02.05", " 3-4-2021 ", "junk", None])
    assert got == ["2020-02-01", "2020-13-31", "2020-01-02", "2005-02-01", "2021-04-03", "junk", None]
    assert apply(spark, lambda c: T.normalize_date(c, strict_legacy=True), ["01.02.05"]) == ["205-02-01"]


def test_cities(spark):
    assert apply(spark, T.normalize_city, ["istabul", " 34 ", "ANKARA", "nowhere", None]) == ["İstanbul", "İstanbul", "Ankara", "nowhere", None]


def test_idempotent(spark):
    values = ["  İstanbul ", "ÇOK  güzel", "é x", "1.2.2020"]
    for fn in (T.tr_lower, T.tr_upper, T.normalize_whitespace, T.normalize_unicode, T.normalize_date):
        once = apply(spark, fn, values)
        assert apply(spark, fn, once) == once


def test_text_columns_and_pipeline(spark):
    df = spark.createDataFrame([("1", " a ", 1), ("2", "b", 2), ("3", "4", 3), ("4", None, 4), ("x", "c", 5)], "n string, s string, i int")
    assert T.text_columns(df) == ["s"]
    out, skipped = T.normalize_frame(df, operations=("strip_whitespace", "no_such_operation"))
    assert skipped == {"n": "numeric_column", "i": "numeric_column"}
    assert [r["s"] for r in out.orderBy("i").collect()] == ["a", "b", "4", None, "c"]
    assert T.change_summary(df, ["s"], ("strip_whitespace",)).first().asDict() == {"column": "s", "total": 5, "changes": 1, "change_pct": 20.0}
    assert [tuple(r) for r in T.changed_rows(df, "s", ("strip_whitespace",), limit=3).collect()] == [(" a ", "a")]


def test_numbers(spark):
    assert apply(spark, N.parse_tr_number, ["1.250,50", "1.000.000", "1250,5", "abc", "-3", "1.5", None]) == [1250.5, 1e6, None, None, -3.0, 1.5, None]
    assert apply(spark, N.to_number, ["1d", " 2 ", "1e3", "nan", "1_0"]) == [None, 2.0, 1000.0, None, None]
    assert apply(spark, N.is_float_like, ["1,5", "1 000", "nan", "-inf", "x", "1e5", "", "."]) == [True, True, True, True, False, True, False, False]
    df = spark.createDataFrame([(9.99999999999,), (0.00123,), (45.0,)], "x double")
    assert [r[0] for r in df.select(N.first_digit(F.col("x"))).collect()] == [1, 1, 4]


def test_distribution_tails():
    assert math.isclose(S.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(S.chi2_sf(15.50731305586545, 8), 0.05, rel_tol=1e-9)
    assert math.isclose(S.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(S.f_sf(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(S.normal_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(S.dagostino_k2(100, 0.0, -1.2002400240024003)[0], 33.62988681, rel_tol=1e-6)


def test_tails_against_commons_math(spark):
    m = spark._jvm.org.apache.commons.math3.distribution
    for x, k in ((0.5, 1), (7.0, 3), (40.0, 20)):
        assert math.isclose(S.chi2_sf(x, k), 1 - m.ChiSquaredDistribution(float(k)).cumulativeProbability(x), rel_tol=1e-7, abs_tol=1e-12)
    for f, a, b in ((0.7, 3, 17), (5.5, 2, 30)):
        assert math.isclose(S.f_sf(f, a, b), 1 - m.FDistribution(float(a), float(b)).cumulativeProbability(f), rel_tol=1e-7, abs_tol=1e-12)


def test_shapiro_and_exact_tests():
    w, p = S.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # published example
    assert math.isclose(w, 0.79, abs_tol=0.01) and p < 0.01
    assert S.shapiro_wilk([1, 2, 3, 4, 5, 6, 7])[1] > 0.5
    with pytest.raises(ValueError):
        S.shapiro_wilk([1, 2])
    odds, p = S.fisher_exact(8, 2, 1, 5)
    assert odds == 20 and math.isclose(p, 0.03496503496503495, rel_tol=1e-9)
    assert math.isclose(S.mann_whitney_p(0, 3, 3, 0), 0.1, rel_tol=1e-12)


def test_messages():
    assert i18n.text("load", "tr") == "Yükle" and i18n.text("nothing", "tr") == "nothing"
    assert not i18n.missing_keys("en") and i18n.score_label(76) == "Good"
