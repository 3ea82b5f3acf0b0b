"""Locale-correct text functions as Column expressions; nulls stay null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

# Letters whose case differs in Turkish, or whose Java case mapping changes their length.
UPPER, LOWER = "IİĞÜŞÖÇ", "ıiğüşöç"
TURKISH = "ğĞüÜşŞöÖçÇıİ"
MOJIBAKE = {"Ã¼": "ü", "Ã–": "Ö", "Ã§": "ç", "Ã¶": "ö", "Ã‡": "Ç", "Äž": "Ğ", "Ä±": "ı", "Ä°": "İ", "Å\x9e": "Ş", "Å\x9f": "ş"}
#: White space as Python's ``\s`` has it.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"

# Spellings and plate codes of cities.
CITIES = {
    "İstanbul": ["istanbul", "İstanbul", "ıstanbul", "istabul", "istanbull", "34"],
    "Ankara": ["ankara", "ankra", "06"],
    "İzmir": ["izmir", "İzmir", "35"],
    "Bursa": ["bursa", "16"],
    "Adana": ["adana", "01"],
    "Antalya": ["antalya", "07"],
    "Gaziantep": ["gaziantep", "antep", "27"],
    "Diyarbakır": ["diyarbakır", "dıyarbakır", "diyarbakir", "21"],
    "Kocaeli": ["kocaeli", "izmit", "41"],
    "Konya": ["konya", "42"],
    "Mersin": ["mersin", "33"],
    "Samsun": ["samsun", "55"],
    "Erzurum": ["erzurum", "25"],
    "Eskişehir": ["eskişehir", "eskisehir", "26"],
    "Trabzon": ["trabzon", "61"],
    "Kayseri": ["kayseri", "38"],
    "Hatay": ["hatay", "antakya", "31"],
    "Manisa": ["manisa", "45"],
    "Balıkesir": ["balıkesir", "balikesir", "10"],
}

# Texts that stand for a missing value.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "NaN", "-", "--", "nan", "none")


def strip(x: Column) -> Column:
    """White space off both ends, with Python's notion of it."""
    return F.regexp_replace(x, "(?U)\\A[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z", "")


def tr_lower(x: Column) -> Column:
    return F.lower(F.translate(x, UPPER, LOWER))


def tr_upper(x: Column) -> Column:
    return F.upper(F.translate(x, LOWER, UPPER))


def tr_title(x: Column) -> Column:
    """First letter of each word in upper case, the rest in lower; white space folded."""
    words = F.filter(F.split(x, SPACE), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(tr_upper(F.substring(w, 1, 1)), tr_lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def fix_mojibake(x: Column, aggressive: bool = False) -> Column:
    """Undoes UTF-8 read as Latin-1 where that doesn't lose Turkish letters."""
    raw = F.encode(F.when(x.rlike("\\A[\\x00-\\xFF]*\\z"), x), "ISO-8859-1")
    again = F.try_validate_utf8(raw.cast("string"))
    count = lambda c: F.length(F.regexp_replace(c, f"[^{TURKISH}]", ""))
    out = F.when(again.isNotNull() & (count(again) >= count(x)), again).otherwise(x)
    if aggressive:
        for broken, right in MOJIBAKE.items():
            out = F.replace(out, F.lit(broken), F.lit(right))
    return out


def normalize_unicode(x: Column, form: str = "NFC") -> Column:
    """Unicode normal form; ASCII text never leaves the JVM's code path's result."""

    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return F.when(x.rlike("\\A\\p{ASCII}*\\z"), x).otherwise(norm(x))


def normalize_date(x: Column, strict_legacy: bool = False) -> Column:
    """d/m/yyyy, yyyy/m/d and d/m/yy (separators / . -) as yyyy-MM-dd text, without calendar checks; others stay as they are.

    ``strict_legacy`` keeps the historical result for two-digit years, whose leading zero is lost.
    """
    t = strip(x)
    sep = "[/.\\-]"
    dmy, ymd, short = rf"\A(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})\z", rf"\A(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})\z", rf"\A(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{2}})\z"
    part = lambda p, k: F.regexp_extract(t, p, k)
    two = lambda c: F.lpad(c, 2, "0")
    bare = lambda c: F.regexp_replace(c, "\\A0+(?=[0-9])", "")
    whole = lambda c: bare(c) if strict_legacy else c
    return (
        F.when(t.rlike(dmy), F.concat_ws("-", whole(part(dmy, 3)), two(part(dmy, 2)), two(part(dmy, 1))))
        .when(t.rlike(ymd), F.concat_ws("-", whole(part(ymd, 1)), two(part(ymd, 2)), two(part(ymd, 3))))
        .when(t.rlike(short), F.concat_ws("-", F.concat(F.lit("20"), whole(part(short, 3))), two(part(short, 2)), two(part(short, 1))))
        .otherwise(x)
    )


def normalize_city(x: Column) -> Column:
    """Known spellings and plate codes to the city's name; others stay as they are."""
    table = F.create_map(*[F.lit(v) for city, names in CITIES.items() for n in names for v in (n, city)])
    t = strip(x)
    return F.coalesce(F.try_element_at(table, F.lower(t)), F.try_element_at(table, t), x)


def match_key(x: Column) -> Column:
    """Text prepared for fuzzy matching: Turkish lower case, white space folded; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(tr_lower(x), SPACE, " ")), F.lit(""))


def token_sort(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, SPACE), lambda w: w != "")), " ")


OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "fix_encoding": fix_mojibake,
    "strip_whitespace": normalize_whitespace,
    "unicode_normalize": normalize_unicode,
    "turkish_lower": tr_lower,
    "turkish_upper": tr_upper,
    "turkish_title": tr_title,
    "normalize_dates": normalize_date,
    "normalize_cities": normalize_city,
}
DEFAULT_OPERATIONS = ("fix_encoding", "strip_whitespace", "unicode_normalize")


def is_numeric_field(dtype) -> bool:
    return isinstance(dtype, (NumericType, BooleanType))


def text_columns(df: DataFrame, sample: int = 200, share: float = 0.8) -> list[str]:
    """String columns of whose first ``sample`` non-null values fewer than ``share`` are numbers.

    One bounded read for each column; the columns of a whole file share the scan's first partitions.
    """
    out = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, StringType):
            continue
        c = F.col(f"`{f.name}`")
        number = F.expr(f"try_cast(`{f.name}` as double)").isNotNull() & c.rlike(r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z")
        r = df.where(c.isNotNull()).limit(sample).agg(F.avg(number.cast("double"))).first()[0]
        if r is None or r < share:
            out.append(f.name)
    return out


def apply_operations(x: Column, operations=DEFAULT_OPERATIONS) -> Column:
    """The operations folded into one expression; unknown names are skipped."""
    for op in operations:
        if op in OPERATIONS:
            x = OPERATIONS[op](x)
    return x


def normalize_frame(df: DataFrame, columns: list[str] | None = None, operations=DEFAULT_OPERATIONS) -> tuple[DataFrame, dict[str, str]]:
    """All text columns (or those named) normalised in one projection, and the reasons for columns that were skipped."""
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    texts = set(text_columns(df.select(*[f"`{c}`" for c in wanted])))
    skipped = {c: "numeric_column" for c in wanted if c not in texts}
    out = df.select(*[apply_operations(F.col(f"`{c}`"), operations).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    return out, skipped


def change_summary(df: DataFrame, columns: list[str], operations=DEFAULT_OPERATIONS) -> DataFrame:
    """(column, total, changes, change_pct): cells that the operations change, in one aggregation."""
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(~x.eqNullSafe(apply_operations(x, operations))).alias(f"_c{i}"))
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _c{i}" for i, c in enumerate(columns))
    return row.selectExpr("_n AS total", f"stack({len(columns)}, {stack}) AS (column, changes)").select("column", "total", "changes", F.round(100 * F.col("changes") / F.greatest("total", F.lit(1)), 2).alias("change_pct"))


def changed_rows(df: DataFrame, column: str, operations=DEFAULT_OPERATIONS, limit: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """(original, normalized) of the rows that change; a limit takes a sample that depends only on the seed and the key."""
    x = F.col(f"`{column}`")
    new = apply_operations(x, operations)
    out = df.where(~x.eqNullSafe(new)).select(x.alias("original"), new.alias("normalized"), F.xxhash64(F.col(key) if key else x, F.lit(seed)).alias("_o"))
    out = out.orderBy("_o").limit(limit) if limit else out
    return out.drop("_o")


def nulls_for_tokens(x: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(~x.isin(*tokens), x)
