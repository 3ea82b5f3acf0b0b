"""File loading: encoding and delimiter detection, tolerant CSV, Turkish number repair, name clean-up.

Only bounded samples reach the driver (128 KiB for the encoding, 4 KiB for the
delimiter), read through Spark's file access, so any store that Spark reads works.
"""

from __future__ import annotations

import codecs
import csv
import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions import numbers as N
from plumbline.functions.text import nulls_for_tokens

# The encodings that are tried, in order, and the delimiters.
CHAIN = ("utf-8", "utf-8-sig", "windows-1254", "iso-8859-9", "cp857", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_NATIVE = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "ascii": "UTF-8"}


def head_bytes(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, through the file system of its path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(p)
    if status.isDirectory():
        p = next(f.getPath() for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", ".")))
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def whole_file(spark: SparkSession, path: str, most: int = 1 << 30) -> bytes:
    """All bytes of a workbook or statistics file, which only its own parser can split; a file beyond ``most`` bytes is an error, never cut."""
    data = head_bytes(spark, path, most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes; convert it to CSV or Parquet")
    return data


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field spans lines: some line of the whole file has an odd number of quotes."""
    odd = F.pmod(F.size(F.split(F.col("value"), '"', -1)) - 1, F.lit(2)) == 1
    return not spark.read.text(path).where(odd).isEmpty()


def detect_encoding(sample: bytes) -> str:
    """By byte order mark, else a detector if one is installed, else the first of the chain that decodes the sample."""
    for bom, name in _BOMS:
        if sample.startswith(bom):
            return name
    try:
        sample.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(sample) - 3:  # a character cut by the sample's end
            return "utf-8"
    return fallback_encoding(sample)


def fallback_encoding(sample: bytes) -> str:
    for name in CHAIN:
        try:
            sample[:8192].decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def detect_delimiter(text: str) -> str:
    """By the standard sniffer on 4 KiB, else the most frequent candidate of 2 KiB (ties in the order of the list)."""
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=lambda d: (text[:2048].count(d), -DELIMITERS.index(d)))


def clean_names(names: list[str]) -> list[str]:
    """Word characters only, no leading digit, unique."""
    out = []
    for n in names:
        s = re.sub(r"_+", "_", re.sub(r"\W", "_", str(n).strip())).strip("_")
        s = f"col_{s}" if s[:1].isdigit() else s or "column"
        base, k = s, 0
        while s in out:
            k += 1
            s = f"{base}_{k}"
        out.append(s)
    return out


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> tuple[DataFrame, dict]:
    """All columns as text. Rows with too many fields are skipped, short ones are padded, null tokens become null.

    Files are split over tasks unless a quoted field spans lines, which is looked up in the
    whole file. Encodings that Spark doesn't read natively are decoded line by line on the
    executors; with line breaks inside quotes such a file is an error.
    """
    sample = head_bytes(spark, path, 128 << 10)
    encoding = encoding or detect_encoding(sample)
    text = sample.decode(encoding, "replace")
    delimiter = delimiter or detect_delimiter(text)
    header = next(csv.reader(text.splitlines()[:1], delimiter=delimiter), [])
    names = clean_names([h.lstrip("﻿") for h in header])
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.read.options(header=True, sep=delimiter, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", escape='"', enforceSchema=True).schema(f"{schema}, _bad string")
    if encoding in _NATIVE:
        wide = encoding.startswith("utf-16")  # its line ends and quotes are two bytes each
        df = reader.options(encoding=_NATIVE[encoding], multiLine=wide or breaks_in_quotes(spark, path)).csv(path)
    else:
        rows = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))  # lines as raw bytes
        name = encoding
        if breaks_in_quotes(spark, path):
            raise ValueError(f"{path} has line breaks inside quotes, which can't be read in {encoding}; convert it to UTF-8")

        @F.pandas_udf("string")
        def decoded(s: pd.Series) -> pd.Series:
            return s.map(lambda v: bytes(v).decode(name, "replace"), na_action="ignore")

        parsed = F.from_csv(decoded("value"), f"{schema}, _bad string", {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'})
        first = text.splitlines()[0]
        df = rows.where(F.col("value") != F.lit(bytearray(first.encode(encoding)))).select(parsed.alias("r")).select("r.*")
    # a corrupt record is too long, or too short and padded; only long ones go: a quote-free count of delimiters tells
    fields = F.size(F.split(F.regexp_replace("_bad", '"[^"]*"', ""), re.escape(delimiter)))
    never = F.length(F.col(f"`{names[0]}`")) < 0  # Spark refuses to read a file for its corrupt records alone, as a count would
    df = df.where(F.col("_bad").isNull() | (fields <= len(names)) | never).drop("_bad")
    out = df.select(*[nulls_for_tokens(F.trim(F.col(f"`{n}`"))).alias(n) for n in names])
    return out, {"encoding": encoding, "delimiter": delimiter, "columns": len(names)}


def tr_number_columns(df: DataFrame, order: str | None = None, sample: int = 50, share: float = 0.3) -> list[str]:
    """Text columns of whose first non-null values (by ``order`` where given) enough are Turkish numbers."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            c = F.col(f"`{f.name}`")
            some = df.where(c.isNotNull())
            some = some.orderBy(F.expr(order)) if order else some
            r = some.limit(sample).agg(F.avg(N.is_tr_number(c).cast("double"))).first()[0]
            if r is not None and r >= share:
                out.append(f.name)
    return out


def fix_turkish_numbers(df: DataFrame, order: str | None = None) -> tuple[DataFrame, list[str]]:
    """Those columns as doubles; cells that can't be read become null."""
    cols = tr_number_columns(df, order)
    return df.select(*[N.parse_tr_number(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns]), cols


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers become doubles, decided in one aggregation."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not cols:
        return df
    row = df.agg(*[(F.count(F.col(f"`{c}`")) == F.count(N.to_number(F.col(f"`{c}`")))).alias(f"a{i}") for i, c in enumerate(cols)], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    numbers = {c for i, c in enumerate(cols) if row[f"a{i}"] and row[f"n{i}"]}
    return df.select(*[N.to_number(F.col(f"`{c}`")).alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def load_file(spark: SparkSession, path: str, encoding: str | None = None, sheet: int | str = 0, typed: bool = True) -> tuple[DataFrame, dict]:
    """CSV, Excel, SPSS or Parquet as a DataFrame with clean names and repaired numbers, and what was found out about it."""
    suffix = PurePosixPath(path).suffix.lower()
    meta: dict = {"path": path, "format": suffix.lstrip(".")}
    if suffix == ".csv":
        df, more = read_csv(spark, path, encoding)
        meta |= more
    elif suffix in (".xlsx", ".xlsm"):
        from plumbline.sources.xlsx import read_xlsx

        df = read_xlsx(spark, whole_file(spark, path), sheet)
    elif suffix in (".sav", ".zsav"):
        from plumbline.sources.spss import read_sav

        df, more = read_sav(spark, whole_file(spark, path))
        return df, meta | more
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
        return df.toDF(*clean_names(df.columns)), meta
    elif suffix == ".xls":
        raise ValueError("legacy .xls isn't supported; save it as .xlsx")
    else:
        raise ValueError(f"unsupported format {suffix}")
    numbered = df.withColumn("row number", F.monotonically_increasing_id())  # names of a loaded file have no spaces
    fixed = tr_number_columns(numbered, "`row number`")  # the file's first values decide
    df = df.select(*[N.parse_tr_number(F.col(f"`{c}`")).alias(c) if c in fixed else F.col(f"`{c}`") for c in df.columns])
    meta["tr_number_columns"] = fixed
    return (infer_numbers(df) if typed else df), meta
