"""Workbooks (xlsx: zipped XML) as a source: one sheet, a file per task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(data: bytes, sheet: str | None = None) -> list[list]:
    """Rows of a sheet (the first, unless named): numbers, booleans, texts and None."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    sheets = {s.get("name"): s.get(f"{LINK}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet {sheet}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[sheets[sheet if sheet is not None else next(iter(sheets))]].lstrip("/")
    out = []
    for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}row"):
        values: list = []
        for c in row.iter(f"{MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(values)
            values += [None] * (at - len(values))
            kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
            if kind == "inlineStr":
                values.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
            elif v is None or v.text is None:
                values.append(None)
            elif kind == "s":
                values.append(shared[int(v.text)])
            elif kind == "b":
                values.append(v.text == "1")
            else:
                values.append(float(v.text) if kind == "n" else v.text)
        out.append(values)
    return out


def read(spark: SparkSession, path: str, schema: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """Workbooks below a path; columns by place, with the schema's names and types."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def made(v, type_: pa.DataType):
        if v is None:
            return None
        if pa.types.is_string(type_) or pa.types.is_large_string(type_):
            return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v:g}" if v == int(v) else str(v)
        if pa.types.is_integer(type_):
            return int(float(v))
        if pa.types.is_floating(type_):
            return float(v)
        return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = cells(content.as_py(), sheet)[1 if header else 0 :]
                columns = [[made(r[i] if i < len(r) else None, f.type) for r in rows] for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return found.mapInArrow(run, kind)


def workbook(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    out, main, link = io.BytesIO(), MAIN.strip("{}"), LINK.strip("{}")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()
