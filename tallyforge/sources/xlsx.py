"""First sheet of a spreadsheet file, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_index(ref: str) -> int:
    """STR-16: A1 gives 0."""
    n = 0
    for ch in re.match(r"[A-Za-z]+", ref)[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_zip(content: bytes) -> dict[str, bytes]:
    """SRC-04: files of a ZIP archive by name, stored or deflated."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}


def read_sheet(content: bytes) -> list[dict]:
    """SRC-05: records of the lowest-numbered sheet by header; _row is the sheet's row number; empty rows are skipped."""
    files = read_zip(content)
    names = [n for n in files if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    if not names:
        raise ValueError("no sheet")
    shared = []
    if "xl/sharedStrings.xml" in files:
        shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ET.fromstring(files["xl/sharedStrings.xml"]).iter(f"{NS}si")]
    sheet = ET.fromstring(files[min(names, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))])
    rows = []
    for row in sheet.iter(f"{NS}row"):
        cells: dict[int, str] = {}
        for at, cell in enumerate(row.iter(f"{NS}c")):
            kind, v = cell.get("t"), cell.find(f"{NS}v")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{NS}t"))
            elif kind == "s":
                text = shared[int(v.text)] if v is not None else ""
            else:
                text = (v.text or "") if v is not None else ""
            cells[column_index(cell.get("r")) if cell.get("r") else at] = text.strip()
        if any(cells.values()):
            rows.append((int(row.get("r", len(rows) + 1)), cells))
    if not rows:
        return []
    (_, header), *rest = rows
    return [{h: cells.get(i, "") for i, h in header.items() if h} | {"_row": n} for n, cells in rest]


def read_spreadsheets(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of spreadsheet files, one task a file: columns, _row, _source."""
    return sheets_of(spark.read.format("binaryFile").load(path).select("path", "content"), columns)


def sheets_of(files: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-05 on rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([[*(r.get(c) for c in columns), r["_row"], name.rsplit("/", 1)[-1]] for r in read_sheet(bytes(content))], columns=[*columns, "_row", "_source"])

    schema = ", ".join([*(f"`{c}` string" for c in columns), "_row bigint, _source string"])
    return files.select("path", "content").mapInPandas(run, schema)
