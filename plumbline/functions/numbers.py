"""Numeric scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TR_DECIMAL = r"\A-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+\z"
_TR_GROUPED = r"\A-?[0-9]{1,3}(\.[0-9]{3})+\z"
_NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def clean(x: Column) -> Column:
    """Double with NaN as null, so that there is one kind of missing value."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def to_number(x: Column) -> Column:
    """Text to double; what isn't a number becomes null."""
    return F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))


def is_tr_number(x: Column) -> Column:
    t = F.trim(x)
    return t.rlike(_TR_DECIMAL) | t.rlike(_TR_GROUPED)


def parse_tr_number(x: Column) -> Column:
    """1.250,50 and 1.000.000 to plain numbers; other text as ``to_number`` reads it."""
    t = F.trim(x)
    plain = F.when(t.rlike(_TR_DECIMAL), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(_TR_GROUPED), F.replace(t, F.lit("."), F.lit("")))
    return F.coalesce(plain.try_cast("double"), to_number(x))


def first_digit(x: Column) -> Column:
    """First significant digit of a positive number, after rounding to 11 significant digits."""
    return F.substring(F.format_string("%.10e", F.abs(x.cast("double"))), 1, 1).cast("int")


def is_digits_like(x: Column) -> Column:
    """Only digits once dots, commas and minus signs are gone."""
    return F.regexp_replace(x, "[.,-]", "").rlike(r"\A[0-9]+\z")


def is_float_like(x: Column) -> Column:
    """Reads as a number with a decimal comma or dot, exponents, inf and nan included."""
    t = F.regexp_replace(F.regexp_replace(x, ",", "."), " ", "")
    return t.rlike(r"(?i)\A\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)?\.?(?:[0-9]+(?:_[0-9]+)*)?(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)\s*\z") & t.rlike(r"(?i)[0-9]|inf|nan") & ~t.rlike(r"(?i)\A\s*[+-]?\.?e")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-8)


def corr_label(r: Column) -> Column:
    """Strength of |r|."""
    a = F.abs(r)
    return F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("very weak")


def _steps(value: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(value < cut, name).otherwise(out)
    return out


def d_label(d: Column) -> Column:
    return _steps(F.abs(d), (0.2, 0.5, 0.8), ("negligible", "small", "medium", "large"))


def r_label(r: Column) -> Column:
    return _steps(F.abs(r), (0.1, 0.3, 0.5), ("negligible", "small", "medium", "large"))


def eta_label(eta: Column) -> Column:
    return _steps(eta, (0.01, 0.06, 0.14), ("negligible", "small", "medium", "large"))


def relation_label(r: Column) -> Column:
    return _steps(F.abs(r), (0.1, 0.3, 0.5, 0.7), ("negligible", "weak", "moderate", "strong", "very strong"))


def cramers_label(v: Column) -> Column:
    return _steps(v, (0.1, 0.3), ("weak", "moderate", "strong"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def penalty_grade(p: Column) -> Column:
    return _steps(p, (0.05, 0.15, 0.30, 0.50), ("A", "B", "C", "D", "F"))
