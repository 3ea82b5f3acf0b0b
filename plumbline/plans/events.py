"""Event sourcing over lazy DataFrames: a log of pure transforms with snapshots, rollback and replay."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from plumbline.functions.text import normalize_frame
from plumbline.operators import edits, impute
from plumbline.runtime import materialize

TYPES = ("LOAD", "NORMALIZE", "IMPUTE", "DROP_ROWS", "DROP_COLS", "TYPE_CAST", "CUSTOM")


@dataclass(frozen=True)
class Event:
    type: str
    version: int
    params: dict
    user: str = "system"
    description: str = ""
    event_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


class EventStore:
    """Versions 0..n of a table. Snapshots every ``every`` events are written, so replay and lineage stay short."""

    def __init__(self, origin: DataFrame, every: int = 10):
        self.every = every
        self.events: list[Event] = []
        self.snapshots: dict[int, DataFrame] = {0: origin}
        self._custom: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._lock = threading.RLock()

    @property
    def version(self) -> int:
        return len(self.events)

    def can_undo(self) -> bool:
        return bool(self.events)

    def _run(self, df: DataFrame, e: Event) -> DataFrame:
        p = e.params
        if e.type == "LOAD":
            return self._custom[e.event_id](df)
        if e.type == "NORMALIZE":
            return normalize_frame(df, p.get("columns"), tuple(p["operations"]) if p.get("operations") else ("fix_encoding", "strip_whitespace", "unicode_normalize"))[0]
        if e.type == "IMPUTE":
            for c in p["columns"]:
                df = impute.fill(df, c, p.get("method", "mean"), p.get("constant"), p.get("order"))
            return df
        if e.type == "DROP_ROWS":
            return edits.drop_by_id(df, list(p["ids"]), p.get("rid", "_rid"))
        if e.type == "DROP_COLS":
            return edits.drop_columns(df, list(p["columns"]))
        if e.type == "TYPE_CAST":
            return edits.cast_column(df, p["column"], p["to"])
        return self._custom[e.event_id](df)

    def apply(self, kind: str, params: dict | None = None, fn: Callable[[DataFrame], DataFrame] | None = None, user: str = "system", description: str = "") -> DataFrame:
        """Appends an event and gives the new version. CUSTOM takes ``fn``, LOAD a new table in ``params['df']``."""
        if kind not in TYPES:
            raise ValueError(f"unknown event {kind}")
        params = dict(params or {})
        with self._lock:
            table = params.pop("df", None)
            e = Event(kind, self.version + 1, params, user, description)
            if kind == "LOAD":
                self._custom[e.event_id] = lambda _: table
            elif kind == "CUSTOM":
                if fn is None:
                    raise ValueError("CUSTOM needs fn")
                self._custom[e.event_id] = fn
            out = self._run(self.materialize(), e)
            self.events.append(e)
            if self.version % self.every == 0:
                out = self.snapshots[self.version] = materialize(out, "snapshot")
            return out

    def rollback(self, steps: int = 1) -> DataFrame:
        """Forgets the last events."""
        if steps <= 0:
            raise ValueError("steps must be positive")
        return self._cut(max(0, self.version - steps))

    def to_origin(self) -> DataFrame:
        return self._cut(0)

    def _cut(self, version: int) -> DataFrame:
        with self._lock:
            del self.events[version:]
            self.snapshots = {k: v for k, v in self.snapshots.items() if k <= version}
            return self.materialize()

    def materialize(self, version: int | None = None) -> DataFrame:
        """A version, replayed from the nearest snapshot; errors in replay are raised."""
        version = self.version if version is None else version
        if not 0 <= version <= self.version:
            raise ValueError(f"no version {version}")
        start = max(k for k in self.snapshots if k <= version)
        df = self.snapshots[start]
        for e in self.events[start:version]:
            df = self._run(df, e)
        return df

    def lineage(self) -> list[dict]:
        return [{"event_id": e.event_id, "type": e.type, "timestamp": e.timestamp, "version": e.version, "params": e.params, "user": e.user, "description": e.description} for e in self.events]

    def export_log(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(x, ensure_ascii=False, default=str) + "\n" for x in self.lineage())
