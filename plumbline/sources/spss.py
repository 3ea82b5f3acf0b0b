"""SPSS system files (.sav; .zsav by zlib blocks): dictionary records and plain or byte-coded cases."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

MEASURES = {1: "nominal", 2: "ordinal", 3: "scale"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def ints(self, n: int, order: str) -> tuple[int, ...]:
        return struct.unpack(f"{order}{n}i", self.take(4 * n))


def _plain(data: bytes, order: str, bias: float, packed: bool, encoding: str):
    """Eight-byte elements of the cases; byte-coded ones are unpacked. None is the system-missing value."""
    if not packed:
        for at in range(0, len(data) - 7, 8):
            yield data[at : at + 8]
        return
    at = 0
    while at + 8 <= len(data):
        codes = data[at : at + 8]
        at += 8
        for c in codes:
            if c == 252:
                return
            if 1 <= c <= 251:
                yield struct.pack(f"{order}d", c - bias)
            elif c == 253:
                yield data[at : at + 8]
                at += 8
            elif c == 254:
                yield b" " * 8
            elif c == 255:
                yield None


def parse_sav(data: bytes, encoding: str = "utf-8") -> tuple[list[dict], list[tuple], dict]:
    """Variables, rows and metadata of a system file."""
    r = _Reader(data)
    magic = r.take(4)
    if magic not in (b"$FL2", b"$FL3"):
        raise ValueError("not an SPSS system file")
    r.take(60)
    raw = r.take(4)
    order = "<" if struct.unpack("<i", raw)[0] in (2, 3) else ">"
    _, compression, _, _ = r.ints(4, order)
    bias = struct.unpack(f"{order}d", r.take(8))[0]
    r.take(9 + 8 + 64 + 3)
    variables: list[dict] = []
    slots: list[int] = []  # element of a case -> variable, -1 for the rest of a long string
    labels: dict[str, dict] = {}
    pending: dict | None = None
    while True:
        kind = r.ints(1, order)[0]
        if kind == 2:
            width, has_label, missing, _, _ = r.ints(5, order)
            name = r.take(8).decode("latin-1").strip()
            label = ""
            if has_label:
                n = r.ints(1, order)[0]
                label = r.take((n + 3) // 4 * 4)[:n].decode(encoding, "replace")
            r.take(8 * abs(missing))
            if width >= 0:
                variables.append({"name": name, "width": width, "label": label, "measure": None})
                slots.append(len(variables) - 1)
            else:
                slots.append(-1)
        elif kind == 3:
            pending = {}
            for _ in range(r.ints(1, order)[0]):
                value = r.take(8)
                n = r.take(1)[0]
                pending[value] = r.take((n + 8) // 8 * 8 - 1)[:n].decode(encoding, "replace")
        elif kind == 4:
            for k in r.ints(r.ints(1, order)[0], order):
                v = variables[slots[k - 1]]
                read = (lambda b: b.decode(encoding, "replace").rstrip()) if v["width"] else (lambda b: f"{struct.unpack(f'{order}d', b)[0]:g}")
                labels[v["name"]] = {read(b): t for b, t in (pending or {}).items()}
        elif kind == 6:
            r.take(80 * r.ints(1, order)[0])
        elif kind == 7:
            sub, size, count = r.ints(3, order)
            body = r.take(size * count)
            if sub == 20:
                encoding = body.decode("latin-1").strip()
            elif sub == 13:
                long = dict(p.split("=", 1) for p in body.decode(encoding, "replace").split("\t") if "=" in p)
                for v in variables:
                    v["long"] = long.get(v["name"])
            elif sub == 11 and size == 4:
                per = count // max(1, len(variables))
                for i, v in enumerate(variables):
                    v["measure"] = MEASURES.get(struct.unpack_from(f"{order}i", body, 4 * per * i)[0])
        elif kind == 999:
            r.take(4)
            break
        else:
            raise ValueError(f"unknown record {kind}")
    body = data[r.at :]
    if magic == b"$FL3":  # blocks of zlib data after a header that says where the trailer lies
        _, trailer, _ = struct.unpack(f"{order}3q", body[:24])
        tail = data[trailer:]
        blocks = struct.unpack(f"{order}i", tail[20:24])[0] if len(tail) >= 24 else 0
        entries = [struct.unpack_from(f"{order}qqii", tail, 24 + 24 * i) for i in range(blocks)]
        body = b"".join(zlib.decompress(data[e[1] : e[1] + e[3]]) for e in entries)
    missing = struct.pack(f"{order}d", -1.7976931348623157e308)
    rows, row, parts = [], [], []
    for k, element in enumerate(_plain(body, order, bias, compression in (1, 2), encoding)):
        slot = k % len(slots)
        if slots[slot] >= 0 and variables[slots[slot]]["width"] == 0:
            row.append(None if element is None or element == missing else struct.unpack(f"{order}d", element)[0])
        else:
            parts.append(element or b" " * 8)
            if slot + 1 == len(slots) or slots[slot + 1] >= 0:
                row.append(b"".join(parts).decode(encoding, "replace").rstrip() or None)
                parts = []
        if slot + 1 == len(slots):
            rows.append(tuple(row))
            row = []
    meta = {"variable_labels": {v.get("long") or v["name"]: v["label"] for v in variables}, "value_labels": {v.get("long") or v["name"]: labels[v["name"]] for v in variables if v["name"] in labels}, "measures": {v.get("long") or v["name"]: v["measure"] for v in variables}, "encoding": encoding}
    return variables, rows, meta


def read_sav(spark: SparkSession, data: bytes) -> tuple[DataFrame, dict]:
    """A system file as a DataFrame; labels are column metadata. A file that can't be read gives an empty frame and a warning."""
    try:
        variables, rows, meta = parse_sav(data)
    except (ValueError, struct.error, IndexError, zlib.error) as e:
        return spark.createDataFrame([], "_note string"), {"warnings": [str(e)]}
    names = [v.get("long") or v["name"] for v in variables]
    fields = [StructField(n, StringType() if v["width"] else DoubleType(), True, {"label": v["label"], "measure": v["measure"], "value_labels": meta["value_labels"].get(n, {})}) for n, v in zip(names, variables)]
    return spark.createDataFrame(rows, StructType(fields)), meta
