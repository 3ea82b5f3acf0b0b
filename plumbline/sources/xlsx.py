"""Excel workbooks with the standard library: reading the first or a named sheet, and writing."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.text import NULL_TOKENS
from plumbline.sources.ingest import clean_names

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows that a worksheet can have by its format.
MAX_ROWS = 1_048_576


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(data: bytes, sheet: int | str = 0) -> list[list[str | None]]:
    """Rows of a sheet as text; a format's limit bounds their number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in book.iter(f"{_MAIN}sheet")]
        rid = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[rid].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in root.iter(f"{_MAIN}row"):
        values: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(values)
            values += [None] * (at + 1 - len(values))
            v, kind = c.find(f"{_MAIN}v"), c.get("t")
            if kind == "inlineStr":
                values[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is not None and v.text is not None:
                values[at] = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text
        rows.append(values)
    return rows


def read_xlsx(spark: SparkSession, data: bytes, sheet: int | str = 0) -> DataFrame:
    """A sheet with a header row, all columns as text; null tokens become null."""
    head, *body = cells(data, sheet) or [[]]
    names = clean_names([h or "" for h in head]) or ["column"]
    rows = [tuple(None if v in NULL_TOKENS[:7] else v for v in (r + [None] * len(names))[: len(names)]) for r in body]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet with a header; more rows than the format allows are an error."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(("<row>" + "".join(map(cell, df.columns)) + "</row>").encode())
            for n, r in enumerate(df.toLocalIterator()):
                if n + 2 > MAX_ROWS:
                    raise ValueError(f"a sheet holds {MAX_ROWS} rows")
                f.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
