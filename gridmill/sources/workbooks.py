"""Folders of spreadsheet workbooks as rows, one task per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.sniff import typed

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = "file string, sheet string, row_no bigint, cells array<string>, sheet_no int"
_NAMES = ["file", "sheet", "row_no", "cells", "sheet_no"]


def _column(ref: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[s.get(_REL)].lstrip("/")
        yield s.get("name"), target if target.startswith("xl/") else f"xl/{target}"


def parse_workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) for the rows of one workbook, streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(n) for n in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for sheet, part in _sheets(book):
            with book.open(part) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for i, c in enumerate(row.iter(f"{_MAIN}c")):
                        at = _column(c.get("r", "")) if c.get("r") else i
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells[at] = _text(c)
                        elif value is not None and c.get("t") == "s":
                            cells[at] = shared[int(value.text)]
                        elif value is not None:
                            cells[at] = value.text
                    yield sheet, int(row.get("r", 0)), cells
                    row.clear()


def workbook_rows(files: DataFrame) -> DataFrame:
    """(file, sheet, row_no, cells, sheet_no) of workbooks given as (path, content); sheets are numbered in book order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows, size, place = [], 0, {}
                for sheet, number, cells in parse_workbook(content):
                    rows.append((name, sheet, number, cells, place.setdefault(sheet, len(place))))
                    size += len(cells)
                    if size > 200_000:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)

    return files.select("path", "content").mapInPandas(parse, _ROWS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, cells, sheet_no) of all workbooks under a path or glob."""
    return workbook_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_workbook_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """All workbooks as one table: the first row of each sheet names the columns.

    Without ``sheet`` the first sheet of each file is taken. Columns are matched
    by name, so files may order them differently.
    """
    return workbook_table(read_workbooks(spark, path), sheet)


def workbook_table(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """One table from workbook rows; see ``read_workbook_table``."""
    if sheet is not None:
        rows = rows.filter(F.col("sheet") == sheet)
    else:
        keep = rows.groupBy("file").agg(F.min_by("sheet", "sheet_no").alias("__sheet")).withColumnRenamed("file", "__file")
        rows = rows.join(keep, (F.col("file") == F.col("__file")) & (F.col("sheet") == F.col("__sheet"))).drop("__file", "__sheet")
    heads = rows.groupBy("file").agg(F.min("row_no").alias("__head"), F.min_by("cells", "row_no").alias("__names")).withColumnRenamed("file", "__hf")
    data = rows.join(heads, F.col("file") == F.col("__hf")).filter(F.col("row_no") > F.col("__head"))
    names = [r[0] for r in heads.select(F.explode("__names").alias("n")).filter("n IS NOT NULL").distinct().orderBy("n").collect()]
    value = lambda n: F.get("cells", (F.array_position("__names", n) - 1).cast("int"))
    return typed(data.select(*[F.when(F.array_contains("__names", n), value(n)).alias(n) for n in names]))
