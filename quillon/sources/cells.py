"""Workbooks (binaryFile rows) as a table of cells, read with the standard library."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of what is admitted.
LIMITS = {"entries": 128, "total": 20 << 20, "entry": 10 << 20, "sheets": 4, "rows": 10_000, "columns": 64, "cells": 100_000, "depth": 64, "elements": 500_000, "name": 1024}
_CELLS = "source_id string, code string, sheet_ordinal int, sheet_name string, visible boolean, row_number int, column string, value_type string, value_text string, is_formula boolean"
_NAME = re.compile(r"([A-Z]+)([0-9]+)$")


class Refused(ValueError):
    pass


def admit(package: zipfile.ZipFile) -> None:
    entries = package.infolist()
    if len(entries) > LIMITS["entries"]:
        raise Refused("package_entries_exceeded")
    if any(e.flag_bits & 1 for e in entries):
        raise Refused("package_encrypted")
    if any(e.file_size > LIMITS["entry"] for e in entries) or sum(e.file_size for e in entries) > LIMITS["total"]:
        raise Refused("package_size_exceeded")
    if any("vbaProject" in e.filename or "externalLink" in e.filename for e in entries):
        raise Refused("package_content_refused")


class _Bounded(ElementTree.TreeBuilder):
    """Builds a tree within the limits of depth, names, and elements of the whole package."""

    def __init__(self, package: zipfile.ZipFile) -> None:
        super().__init__()
        self.package, self.depth = package, 0

    def start(self, tag, attrs):
        self.depth += 1
        self.package.elements = getattr(self.package, "elements", 0) + 1
        if self.depth > LIMITS["depth"] or self.package.elements > LIMITS["elements"] or max(map(len, (tag, *attrs))) > LIMITS["name"]:
            raise Refused("xml_structure_exceeded")
        if attrs.get("TargetMode", "").lower() == "external":
            raise Refused("package_content_refused")
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = package.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Refused("package_content_refused")
    parser = ElementTree.XMLParser(target=_Bounded(package))
    parser.feed(data)
    return parser.close()


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _date_styles(package: zipfile.ZipFile) -> frozenset[str]:
    """Numbers of the cell styles that show a date."""
    custom, styles = {}, []
    for e in _xml(package, "xl/styles.xml").iter():
        if _local(e) == "numFmt":
            plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", ""))
            custom[e.get("numFmtId")] = bool(re.search("[dy]", plain, re.I))
        elif _local(e) == "cellXfs":
            styles = [x.get("numFmtId", "0") for x in e]
    built_in = {*range(14, 18), 22, *range(27, 37), *range(50, 59)}
    return frozenset(str(k) for k, f in enumerate(styles) if custom.get(f, f.isdecimal() and int(f) in built_in))


def _serial_date(text: str, late: bool) -> str | None:
    """The day of a serial number, in the system of 1900 or 1904; null if there is none."""
    try:
        days = int(float(text))
        return str(datetime.date(1904, 1, 1) + datetime.timedelta(days) if late else datetime.date(1899, 12, 30) + datetime.timedelta(days + (days < 60)))
    except (ValueError, OverflowError):
        return None


def sheet_cells(content: bytes) -> Iterator[tuple]:
    """(ordinal, name, visible, row, column, type, text, formula) of every cell with content; a
    merged range is a row of type ``merge`` without a place, its text the range."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        admit(package)
        names = set(package.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in _xml(package, "xl/sharedStrings.xml")]
        target = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in _xml(package, "xl/_rels/workbook.xml.rels")}
        workbook = _xml(package, "xl/workbook.xml")
        sheets = [s for s in workbook.iter() if _local(s) == "sheet"]
        late = any(_local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in workbook.iter())
        dated = _date_styles(package) if "xl/styles.xml" in names else frozenset()
        if len(sheets) > LIMITS["sheets"]:
            raise Refused("sheets_exceeded")
        spelled = 0  # characters of shared strings, each time that a cell shows one
        for ordinal, sheet in enumerate(sheets):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            count, last, widest = 0, 0, 0
            # the declared dimension is not looked at
            for c in _xml(package, "xl/" + target[link]).iter():
                if _local(c) == "mergeCell":
                    yield ordinal, sheet.get("name"), sheet.get("state", "visible") == "visible", None, None, "merge", c.get("ref"), False
                if _local(c) != "c":
                    continue
                m, count = _NAME.match(c.get("r", "")), count + 1
                column = 0
                for letter in m[1] if m else "":
                    column = column * 26 + ord(letter) - 64
                last, widest = max(last, int(m[2]) if m else 0), max(widest, column)
                if not m or last > LIMITS["rows"] or widest > LIMITS["columns"] or max(count, last * widest) > LIMITS["cells"]:
                    raise Refused("sheet_extent_exceeded")
                parts = {_local(x): x for x in c}
                kind = c.get("t", "n")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                else:
                    text = parts["v"].text if "v" in parts else None
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                        spelled += len(text)
                        if spelled > LIMITS["total"]:
                            raise Refused("shared_strings_exceeded")
                if kind == "n" and text is not None and c.get("s") in dated:
                    kind, text = "date", _serial_date(text, late)
                if kind == "d":
                    kind, text = "date", text and text[:10]
                if text is not None or "f" in parts:
                    yield ordinal, sheet.get("name"), sheet.get("state", "visible") == "visible", int(m[2]), m[1], "text" if kind in ("s", "str", "inlineStr") else kind, text, "f" in parts


def xlsx_cells(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Cells of every workbook; one that is refused is a row with only its code."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _CELLS.split(", ")]
        for part in parts:
            for source, data in zip(part["source_id"], part["content"], strict=True):
                try:
                    rows = [(source, None, *c) for c in sheet_cells(data)]
                except Refused as e:
                    rows = [(source, str(e), *[None] * 8)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, IndexError):
                    rows = [(source, "package_invalid", *[None] * 8)]
                yield pd.DataFrame(rows, columns=names).astype({"sheet_ordinal": "Int32", "row_number": "Int32"})

    return files.select(F.col(key).cast("string").alias("source_id"), F.col(content).alias("content")).mapInPandas(run, _CELLS)


def wide(cells: DataFrame, letters: str = "ABCDEFGH") -> DataFrame:
    """A row for each row of a sheet: the texts of its columns, ``types`` by letter, and whether
    any is a formula or not a text."""
    return (
        cells.filter("code IS NULL AND row_number IS NOT NULL")
        .groupBy("source_id", "sheet_ordinal", "row_number")
        .agg(
            *(F.max(F.when(F.col("column") == x, F.col("value_text"))).alias(x) for x in letters),
            F.map_from_entries(F.collect_list(F.struct("column", "value_type"))).alias("types"),
            F.bool_or("is_formula").alias("has_formula"),
            F.bool_or(F.col("value_type") != "text").alias("has_other_type"),
        )
    )
