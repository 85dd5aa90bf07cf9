"""Excel workbooks, one task per file; a sheet cannot hold more than 1,048,576 rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.session import scratch_dir

# XML names of the Office Open XML spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

ROWS_PER_BATCH = 5_000


def read_workbooks(spark: SparkSession, path: str | list[str], header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The first sheet of every workbook under ``path``, all cells as text.

    Columns are the headers of all files together, or ``column_1`` and so on up
    to the widest row, unless ``columns`` names them. The parsed rows are written
    once, so that finding names and types does not parse a workbook again.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield from _sheet_batches(name, content, header)

    rows = files.select("path", "content").mapInPandas(parse, "path string, row_number int, cells map<string,string>")
    parsed = scratch_dir(spark, "workbook-rows")
    rows.write.parquet(parsed)
    rows = spark.read.schema(rows.schema).parquet(parsed)
    if columns is None:
        names = rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct()
        columns = sorted((r[0] for r in names.collect()), key=_natural)
    return rows.select([F.col("cells")[c].alias(c) for c in columns])


def _natural(name: str) -> list:
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.split(r"(\d+)", name) if p]


def _sheet_batches(path: str, content: bytes, header: bool) -> Iterator[pd.DataFrame]:
    names: list[str] | None = None
    numbers: list[int] = []
    cells: list[dict[str, str]] = []
    for index, row in enumerate(sheet_rows(content)):
        if header and index == 0:
            names = [c.strip() for c in row]
            continue
        if header:
            record = {n: v for n, v in zip(names, row) if n}
        else:
            record = {f"column_{i + 1}": v for i, v in enumerate(row)}
        numbers.append(index + 1)
        cells.append(record)
        if len(cells) == ROWS_PER_BATCH:
            yield pd.DataFrame({"path": path, "row_number": numbers, "cells": cells})
            numbers, cells = [], []
    if cells:
        yield pd.DataFrame({"path": path, "row_number": numbers, "cells": cells})


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as text, trailing empty cells left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != f"{MAIN}row":
                    continue
                row: list[str] = []
                for cell in element.iter(f"{MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([""] * (at - len(row)))
                    row.append(_cell_text(cell, shared))
                while row and row[-1] == "":
                    row.pop()
                yield row
                element.clear()


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = workbook.find(f"{MAIN}sheets/{MAIN}sheet")
    if sheet is None:
        raise ValueError("the workbook has no sheets")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    for link in links.iter(f"{PACKAGE_REL}Relationship"):
        if link.get("Id") == sheet.get(f"{REL}id"):
            target = link.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("the first sheet has no content")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _column_index(reference: str) -> int:
    index = 0
    for ch in reference:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - ord("A") + 1
    return index - 1


def _cell_text(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v") or ""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value
