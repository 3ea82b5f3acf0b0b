"""An operation log that runs as a DataFrame plan and can be emitted as PySpark, pandas or R code."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.text import DEFAULT_OPERATIONS, apply_operations
from plumbline.operators import edits, impute, profile


class OperationLog:
    """Steps in order; ``run`` executes exactly what the emitted code says."""

    def __init__(self):
        self.steps: list[dict] = []
        self._custom: dict[int, Callable[[DataFrame], DataFrame]] = {}

    def _add(self, step: str, /, **params) -> OperationLog:
        self.steps.append({"op": step, "params": params, "timestamp": datetime.now(timezone.utc).isoformat()})
        return self

    def load(self, path: str, fmt: str = "parquet"):
        return self._add("load", path=path, fmt=fmt)

    def filter(self, column: str, op: str, value):
        return self._add("filter", column=column, op=op, value=value)

    def drop_cols(self, columns: list[str]):
        return self._add("drop_cols", columns=columns)

    def drop_rows(self, condition: str):
        return self._add("drop_rows", condition=condition)

    def keep_rows(self, condition: str):
        return self._add("keep_rows", condition=condition)

    def rename(self, names: dict[str, str]):
        return self._add("rename", names=names)

    def normalize(self, columns: list[str], operations=DEFAULT_OPERATIONS):
        return self._add("normalize", columns=columns, operations=list(operations))

    def impute(self, columns: list[str], method: str, constant=None, order: str | None = None):
        return self._add("impute", columns=columns, method=method, constant=constant, order=order)

    def cast(self, column: str, to: str):
        return self._add("cast", column=column, to=to)

    def sort(self, columns: list[str], ascending: bool = True):
        return self._add("sort", columns=columns, ascending=ascending)

    def deduplicate(self, subset: list[str], order: list[str]):
        return self._add("deduplicate", subset=subset, order=order)

    def custom(self, code: str, fn: Callable[[DataFrame], DataFrame]):
        self._custom[len(self.steps)] = fn
        return self._add("custom", code=code)

    def clear(self) -> None:
        self.steps.clear()
        self._custom.clear()

    def summary(self) -> dict[str, int]:
        return dict(Counter(s["op"] for s in self.steps))

    def to_json(self) -> str:
        return json.dumps(self.steps, ensure_ascii=False, indent=2, default=str)

    def run(self, df: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
        for i, s in enumerate(self.steps):
            p = s["params"]
            match s["op"]:
                case "load":
                    df = spark.read.option("header", True).format(p["fmt"]).load(p["path"])
                case "filter":
                    df = edits.filter_rows(df, p["column"], p["op"], p["value"])
                case "drop_cols":
                    df = edits.drop_columns(df, p["columns"])
                case "drop_rows":
                    df = edits.drop_rows(df, p["condition"])
                case "keep_rows":
                    df = edits.keep_rows(df, p["condition"])
                case "rename":
                    df = edits.rename_columns(df, p["names"])
                case "normalize":
                    for c in p["columns"]:
                        df = df.withColumn(c, apply_operations(df[c], p["operations"]))
                case "impute":
                    for c in p["columns"]:
                        df = impute.fill(df, c, p["method"], p["constant"], p["order"])
                case "cast":
                    df = edits.cast_column(df, p["column"], p["to"])
                case "sort":
                    df = edits.sort_rows(df, p["columns"], p["ascending"])
                case "deduplicate":
                    df = profile.dedup_first(df, p["subset"], p["order"])
                case "custom":
                    df = self._custom[i](df)
        return df

    def to_pyspark(self) -> str:
        """A script that reproduces ``run`` with this package."""
        lines = ["from pyspark.sql import SparkSession", "from plumbline.functions.text import apply_operations", "from plumbline.operators import edits, impute, profile", "", "spark = SparkSession.builder.getOrCreate()"]
        for s in self.steps:
            p = s["params"]
            match s["op"]:
                case "load":
                    lines.append(f"df = spark.read.option('header', True).format({p['fmt']!r}).load({p['path']!r})")
                case "filter":
                    lines.append(f"df = edits.filter_rows(df, {p['column']!r}, {p['op']!r}, {p['value']!r})")
                case "drop_cols":
                    lines.append(f"df = edits.drop_columns(df, {p['columns']!r})")
                case "drop_rows" | "keep_rows":
                    lines.append(f"df = edits.{s['op']}(df, {p['condition']!r})")
                case "rename":
                    lines.append(f"df = edits.rename_columns(df, {p['names']!r})")
                case "normalize":
                    lines += [f"df = df.withColumn({c!r}, apply_operations(df[{c!r}], {p['operations']!r}))" for c in p["columns"]]
                case "impute":
                    lines += [f"df = impute.fill(df, {c!r}, {p['method']!r}, {p['constant']!r}, {p['order']!r})" for c in p["columns"]]
                case "cast":
                    lines.append(f"df = edits.cast_column(df, {p['column']!r}, {p['to']!r})")
                case "sort":
                    lines.append(f"df = edits.sort_rows(df, {p['columns']!r}, {p['ascending']!r})")
                case "deduplicate":
                    lines.append(f"df = profile.dedup_first(df, {p['subset']!r}, {p['order']!r})")
                case "custom":
                    lines.append(p["code"])
        return "\n".join(lines) + "\n"

    def to_pandas(self) -> str:
        lines = ["import pandas as pd", ""]
        for s in self.steps:
            p = s["params"]
            match s["op"]:
                case "load":
                    lines.append(f"df = pd.read_{p['fmt']}({p['path']!r})")
                case "filter":
                    lines.append(f"df = df[df[{p['column']!r}] {'==' if p['op'] == '=' else p['op']} {p['value']!r}]")
                case "drop_cols":
                    lines.append(f"df = df.drop(columns={p['columns']!r}, errors='ignore')")
                case "drop_rows":
                    lines.append(f"df = df.drop(df.query({p['condition']!r}).index)")
                case "keep_rows":
                    lines.append(f"df = df.query({p['condition']!r})")
                case "rename":
                    lines.append(f"df = df.rename(columns={p['names']!r})")
                case "normalize":
                    lines += [f"# {', '.join(p['operations'])}", *[f"df[{c!r}] = df[{c!r}].str.replace(r'\\s+', ' ', regex=True).str.strip()" for c in p["columns"] if "strip_whitespace" in p["operations"]], *[f"df[{c!r}] = df[{c!r}].str.normalize('NFC')" for c in p["columns"] if "unicode_normalize" in p["operations"]]]
                case "impute":
                    fills = {"mean": "fillna(df[{c}].mean())", "median": "fillna(df[{c}].median())", "mode": "fillna(df[{c}].mode().iloc[0])", "constant": f"fillna({p['constant']!r})", "ffill": "ffill()", "bfill": "bfill()", "interpolate": "interpolate(limit_direction='both')"}
                    lines += [f"df[{c!r}] = df[{c!r}].{fills[p['method']].format(c=repr(c))}" for c in p["columns"]]
                case "cast":
                    how = {"numeric": "pd.to_numeric({0}, errors='coerce')", "str": "{0}.astype('string')", "datetime": "pd.to_datetime({0}, errors='coerce')"}[p["to"]]
                    lines.append(f"df[{p['column']!r}] = " + how.format(f"df[{p['column']!r}]"))
                case "sort":
                    lines.append(f"df = df.sort_values({p['columns']!r}, ascending={p['ascending']!r})")
                case "deduplicate":
                    lines.append(f"df = df.sort_values({p['order']!r}).drop_duplicates(subset={p['subset']!r})")
                case "custom":
                    lines.append(p["code"])
        return "\n".join(lines) + "\n"

    def to_r(self) -> str:
        name = lambda c: f"`{c}`"
        value = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, str) else "NA" if v is None else str(v).upper() if isinstance(v, bool) else str(v)
        lines = ["library(dplyr)", "library(tidyr)", ""]
        for s in self.steps:
            p = s["params"]
            match s["op"]:
                case "load":
                    reader = {"csv": "read.csv", "parquet": "arrow::read_parquet"}.get(p["fmt"], "read.csv")
                    lines.append(f"df <- {reader}({value(p['path'])})")
                case "filter":
                    lines.append(f"df <- df %>% filter({name(p['column'])} {'==' if p['op'] == '=' else p['op']} {value(p['value'])})")
                case "drop_cols":
                    lines.append(f"df <- df %>% select(-any_of(c({', '.join(value(c) for c in p['columns'])})))")
                case "drop_rows":
                    lines.append(f"df <- df %>% filter(!coalesce({p['condition']}, FALSE))")
                case "keep_rows":
                    lines.append(f"df <- df %>% filter({p['condition']})")
                case "rename":
                    lines.append("df <- df %>% rename(" + ", ".join(f"{name(b)} = {name(a)}" for a, b in p["names"].items()) + ")")
                case "normalize":
                    lines += [f"df${name(c)} <- trimws(gsub('\\\\s+', ' ', df${name(c)}))" for c in p["columns"]]
                case "impute":
                    how = {"mean": "mean(df${0}, na.rm = TRUE)", "median": "median(df${0}, na.rm = TRUE)", "constant": value(p["constant"]), "mode": "names(sort(-table(df${0})))[1]"}
                    lines += [f"df <- df %>% fill({name(c)}, .direction = '{'down' if p['method'] == 'ffill' else 'up'}')" if p["method"] in ("ffill", "bfill") else f"df${name(c)} <- zoo::na.approx(df${name(c)}, rule = 2)" if p["method"] == "interpolate" else f"df${name(c)}[is.na(df${name(c)})] <- {how[p['method']].format(name(c))}" for c in p["columns"]]
                case "cast":
                    fn = {"numeric": "as.numeric", "str": "as.character", "datetime": "as.POSIXct"}[p["to"]]
                    lines.append(f"df${name(p['column'])} <- {fn}(df${name(p['column'])})")
                case "sort":
                    lines.append("df <- df %>% arrange(" + ", ".join(name(c) if p["ascending"] else f"desc({name(c)})" for c in p["columns"]) + ")")
                case "deduplicate":
                    lines.append(f"df <- df %>% arrange({', '.join(map(name, p['order']))}) %>% distinct({', '.join(map(name, p['subset']))}, .keep_all = TRUE)")
                case "custom":
                    lines.append("# " + p["code"].replace("\n", "\n# "))
        return "\n".join(lines) + "\n"
