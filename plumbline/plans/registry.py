"""Tables, immutable originals, versioned results, lineage and restore points of a session."""

from __future__ import annotations

import threading
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import profile as P

WORKING, ORIGINALS = ("ds_primary", "ds_secondary"), ("ds_original_p", "ds_original_s")
RESTORE = "restore_point"


class Registry:
    """Names DataFrames. Originals are never replaced; a working copy is a pointer to its newest version.

    With ``path`` each version is written as Parquet under ``path/<name>/v=<N>`` and
    read back, which cuts its lineage; without, versions stay lazy.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.tables: dict[str, DataFrame] = {}
        self.originals: dict[str, DataFrame] = {}
        self.versions: dict[str, list[str]] = {}
        self.lineage: list[dict] = []
        self._profiles: dict[tuple[str, int], dict] = {}
        self._touch: dict[str, int] = {}
        self._lock = threading.RLock()

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self._touch[name] = self._touch.get(name, 0) + 1
        df.createOrReplaceTempView(name)

    def _note(self, operation: str, table: str, **more) -> None:
        self.lineage.append({"timestamp": datetime.now(timezone.utc).isoformat(), "operation": operation, "table": table, **more})

    def register(self, df: DataFrame, name: str = WORKING[0], source: str | None = None, **more) -> str:
        """A loaded table and its immutable original."""
        with self._lock:
            original = ORIGINALS[0] if name == WORKING[0] else ORIGINALS[1] if name == WORKING[1] else f"{name}_original"
            if original in self.originals and name not in WORKING:
                raise ValueError(f"{name} is registered already")
            self._put(name, df)
            self.originals[original] = df
            self._put(original, df)
            self._note("LOAD", name, source=source, **more)
            return name

    def write_result(self, df: DataFrame, name: str, source_table: str, operation: str = "TRANSFORM") -> str:
        """The next version ``ds_result_<name>_v<N>``."""
        with self._lock:
            history = self.versions.setdefault(name, [])
            n = len(history) + 1
            table = f"ds_result_{name}_v{n}"
            if self.path:
                where = f"{self.path}/{name}/v={n}"
                df.write.mode("overwrite").parquet(where)
                df = self.spark.read.parquet(where)
            self._put(table, df)
            history.append(table)
            self._note(operation, table, source=source_table, version=n)
            return table

    def update_working_copy(self, df: DataFrame, name: str = WORKING[0]) -> None:
        if name in self.originals:
            raise ValueError(f"{name} is immutable")
        self._put(name, df)
        self._note("UPDATE", name)

    def get(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(name)
        return self.tables[name]

    def original(self, name: str = WORKING[0]) -> DataFrame:
        return self.originals[ORIGINALS[0] if name == WORKING[0] else ORIGINALS[1] if name == WORKING[1] else f"{name}_original"]

    def exists(self, name: str) -> bool:
        return name in self.tables

    def columns(self, name: str) -> list[str]:
        return self.get(name).columns

    def numeric_columns(self, name: str) -> list[str]:
        return P.numeric_columns(self.get(name))

    def string_columns(self, name: str) -> list[str]:
        return P.string_columns(self.get(name))

    def names(self) -> list[str]:
        return sorted(self.tables)

    def remove(self, name: str) -> None:
        with self._lock:
            backup = ORIGINALS[WORKING.index(name)] if name in WORKING else f"{name}_original"
            for n in (name, backup):
                if self.tables.pop(n, None) is not None:
                    self.spark.catalog.dropTempView(n)
                self.originals.pop(n, None)
            self._profiles = {k: v for k, v in self._profiles.items() if k[0] != name}

    def latest(self, name: str) -> str | None:
        return (self.versions.get(name) or [None])[-1]

    def history(self, prefix: str = "") -> list[str]:
        return [t for n in sorted(self.versions) if n.startswith(prefix) for t in self.versions[n]]

    def undo_last(self, name: str) -> str | None:
        """Drops the newest version if it isn't the only one; the table that is newest then."""
        with self._lock:
            history = self.versions.get(name, [])
            if len(history) > 1:
                gone = history.pop()
                self.tables.pop(gone, None)
                self.spark.catalog.dropTempView(gone)
            return self.latest(name)

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the registered tables."""
        return self.spark.sql(sql)

    def profile(self, name: str, column: str) -> dict | None:
        """The column's profile, kept for the table's current version."""
        key = name, self._touch.get(name, 0)
        if key not in self._profiles:
            self._profiles[key] = {r["column"]: r.asDict() for r in P.column_profile(self.get(name)).collect()}  # a row for each column
        return self._profiles[key].get(column)

    def create_restore_point(self, name: str = WORKING[0]) -> str:
        return self.write_result(self.get(name), RESTORE, name, "BACKUP")

    def restore(self, target: str = WORKING[0]) -> None:
        table = self.latest(RESTORE)
        if table is None:
            raise ValueError("there is no restore point")
        self.update_working_copy(self.get(table), target)


def export(df: DataFrame, path: str, fmt: str, single_file: bool = False) -> str:
    """CSV, Parquet or xlsx. ``single_file`` writes one CSV with a byte order mark by streaming partitions through the driver."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv" and not single_file:
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "csv":
        import csv

        with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
            w = csv.writer(f)
            w.writerow(df.columns)
            for r in df.toLocalIterator():  # one partition at a time
                w.writerow(["" if v is None else v for v in r])
    elif fmt == "xlsx":
        from plumbline.sources.xlsx import write_xlsx

        write_xlsx(df, path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path
