"""Append-only audit log (JSON lines), its roll-up, session trust score and Markdown report."""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Change of the session's trust score after each kind of operation.
TRUST_DELTAS = {"normalize": 5, "iqr": 4, "benford_ok": 3, "impute": 8}

SCHEMA = "session_id string, operation string, status string, timestamp string, duration_ms double, params map<string,string>, result map<string,string>, effect_size struct<cohen_d: double>, data_integrity_hash string"


def json_safe(x):
    """Plain JSON values: NaN and infinities as null, tuples and arrays as lists, times in ISO format, keys as text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if hasattr(x, "tolist"):
        return json_safe(x.tolist())
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


def value_hash(x) -> str:
    return hashlib.sha256(json.dumps(json_safe(x), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class AuditLog:
    def __init__(self, folder: str):
        self.session_id = uuid.uuid4().hex[:8]
        Path(folder).mkdir(parents=True, exist_ok=True)
        self.path = Path(folder) / f"session_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{self.session_id}.jsonl"
        self.records: list[dict] = []
        self._lock = threading.Lock()

    def log(self, operation: str, status: str = "success", duration_ms: float = 0.0, params: dict | None = None, result: dict | None = None, effect_size: dict | None = None, data=None) -> dict:
        record = json_safe({
            "session_id": self.session_id, "operation": operation.upper(), "status": status.upper(), "timestamp": datetime.now(timezone.utc), "duration_ms": round(duration_ms, 3),
            "params": params or {}, "result": result or {}, "effect_size": effect_size, "data_integrity_hash": value_hash(data) if data is not None else None,
        })
        with self._lock:
            self.records.append(record)
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(record, ensure_ascii=False) + "\n")
        return record

    def timed(self, operation: str, fn, **more):
        """Runs ``fn`` and logs how long it took and whether it failed."""
        start = time.perf_counter()
        try:
            out = fn()
        except Exception as e:
            self.log(operation, "error", 1000 * (time.perf_counter() - start), result={"error": str(e)}, **more)
            raise
        self.log(operation, "success", 1000 * (time.perf_counter() - start), **more)
        return out

    def get_records(self, operation: str | None = None) -> list[dict]:
        return [r for r in self.records if operation is None or r["operation"] == operation.upper()]

    def log_load(self, path: str, rows: int, columns: int, duration_ms: float) -> dict:
        return self.log("load", duration_ms=duration_ms, params={"path": path}, result={"rows": rows, "columns": columns})

    def log_normalize(self, column: str, changes: int, rows: int, operations: list[str], duration_ms: float, effect: dict | None = None) -> dict:
        return self.log("normalize", duration_ms=duration_ms, params={"column": column, "operations": operations}, result={"changes": changes, "change_rate": round(100 * changes / max(rows, 1), 2)}, effect_size=effect)

    def log_benford(self, column: str, verdict: dict, duration_ms: float) -> dict:
        return self.log("benford", "warning" if verdict["suspicious"] else "success", duration_ms, {"column": column}, verdict)

    def log_outlier(self, column: str, method: str, found: int, rows: int, duration_ms: float) -> dict:
        return self.log("outlier", duration_ms=duration_ms, params={"column": column, "method": method}, result={"outliers": found, "outlier_rate": round(100 * found / max(rows, 1), 2)})

    def log_match(self, algorithm: str, threshold: float, matched: int, primary: int, duration_ms: float) -> dict:
        return self.log("match", duration_ms=duration_ms, params={"algorithm": algorithm, "threshold": threshold}, result={"matched": matched, "match_rate": round(100 * matched / max(primary, 1), 2)})

    def log_impute(self, column: str, method: str, filled: int, rows: int, duration_ms: float, effect: dict | None = None) -> dict:
        return self.log("impute", duration_ms=duration_ms, params={"column": column, "method": method}, result={"filled": filled, "fill_rate": round(100 * filled / max(rows, 1), 2)}, effect_size=effect)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of any number of sessions as a DataFrame."""
    return spark.read.schema(SCHEMA).json(path)


def rollup(records: DataFrame) -> DataFrame:
    """(operation, n, n_success, n_warning, n_error, mean_abs_d, mean_ms)."""
    return records.groupBy("operation").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s.upper()).alias(f"n_{s}") for s in ("success", "warning", "error")],
        F.round(F.avg(F.abs("effect_size.cohen_d")), 4).alias("mean_abs_d"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"),
    )


def session_quality(records: DataFrame) -> DataFrame:
    """(n, n_errors, n_warnings, quality): 100 less 10 for each error and 3 for each warning, between 0 and 100."""
    e, w = F.count_if(F.col("status") == "ERROR"), F.count_if(F.col("status") == "WARNING")
    return records.agg(F.count("*").alias("n"), e.alias("n_errors"), w.alias("n_warnings"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - 10 * e - 3 * w)).cast("long").alias("quality"))


class TrustScore:
    """A session's running score between 0 and 100."""

    def __init__(self, start: float = 0.0):
        self.value = start
        self.history: list[tuple[str, float]] = []

    def apply(self, kind: str, delta: float | None = None) -> float:
        self.value = max(0.0, min(100.0, self.value + (TRUST_DELTAS.get(kind, 0) if delta is None else delta)))
        self.history.append((kind, self.value))
        return self.value


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows], ""]


def _readiness(groups: dict[str, list[dict]], radical: list[str]) -> list[str]:
    """Advice on modelling, from the kinds of operations in the log."""
    out = []
    if {"NORMALIZE", "AUDIT", "OUTLIER", "BENFORD"} & set(groups):
        out.append(f"Regression: test hypotheses first, as {', '.join(radical)} changed a lot." if radical else "Regression: values were cleaned and keep their structure; linear or polynomial models fit.")
    if "IMPUTE" in groups:
        filled = sorted({c for r in groups["IMPUTE"] if (c := (r.get("params") or {}).get("column"))})
        out.append("Classification: gaps were filled" + (f" in {', '.join(filled)}" if filled else "") + "; tree ensembles can follow once categories are encoded.")
    return out


def markdown_report(title: str, meta: dict, log: AuditLog, trust: float, before_after: DataFrame | None = None, correlations: list[dict] | None = None, missing: DataFrame | None = None, samples: list[dict] | None = None, steps: list[str] | None = None, profiles: DataFrame | None = None) -> str:
    """A report from small results: every DataFrame given has a row for each column."""
    out = [f"# {title}", "", f"Generated {datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC", ""]
    changes = [r.asDict() for r in before_after.collect()] if before_after is not None else []
    radical = [r["column"] for r in changes if r["radical_change"]]
    if radical:
        out += [f"> **Radical change** of variance (above 20 %): {', '.join(radical)}", ""]
    filled = round(trust / 5)
    out += ["## Trust", "", f"`{'█' * filled}{'░' * (20 - filled)}` {trust:.1f} / 100", "", "## Source", "", *_table(["property", "value"], [[k, v] for k, v in meta.items()])]
    groups: dict[str, list[dict]] = {}
    for r in log.records:
        groups.setdefault(r["operation"], []).append(r)
    out += ["## Operations", "", *_table(["operation", "runs", "errors", "warnings"], [[k, len(v), sum(r["status"] == "ERROR" for r in v), sum(r["status"] == "WARNING" for r in v)] for k, v in sorted(groups.items())])]
    if changes:
        out += ["## Before and after", "", *_table(["column", "mean", "mean after", "variance change %"], [[r["column"], r["mean_before"], r["mean_after"], r["var_change_pct"]] for r in changes])]
        losses = [abs(r["var_change_pct"]) for r in changes if r["var_change_pct"] is not None]
        if losses:
            loss = sum(losses) / len(losses)
            out += [f"Mean change of variance: {loss:.2f} %" + (" (warning)" if loss > 20 else ""), ""]
    if samples:
        out += ["## Spot check", "", *_table(["original", "normalized"], [[s["original"], s["normalized"]] for s in samples[:10]])]
    if correlations:
        out += ["## Correlations", "", *_table(["a", "b", "pearson", "strength"], [[c["col_a"], c["col_b"], c["pearson"], c["strength"]] for c in correlations[:8]])]
    if missing is not None:
        out += ["## Missing values", "", *_table(["column", "missing", "%"], [[r["column"], r["missing_count"], r["missing_pct"]] for r in missing.orderBy(F.desc("missing_pct"), "column").limit(12).collect()])]
    if profiles is not None:
        rows = profiles.select("column", "miss_pct", "type_mismatch_pct", "quality_score").orderBy("column").collect()
        level = lambda q: "good" if q >= 80 else "fair" if q >= 50 else "poor"
        out += ["## Column health", "", *_table(["column", "missing %", "type mismatch %", "quality"], [[r[0], f"{r[1]:.1f}", f"{r[2]:.1f}", f"{level(r[3])} ({r[3]:.1f} / 100)"] for r in rows])]
    advice = _readiness(groups, radical)
    if advice:
        out += ["## What the data is ready for", "", *[f"- {a}" for a in advice], ""]
    if steps:
        out += ["## Next steps", "", *[f"{i}. {s}" for i, s in enumerate(steps, 1)], ""]
    out += ["## Log", "", *_table(["time", "operation", "status", "ms"], [[r["timestamp"], r["operation"], r["status"], r["duration_ms"]] for r in log.records[-30:]])]
    return "\n".join(out)
