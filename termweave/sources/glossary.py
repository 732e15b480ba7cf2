"""Glossary files as rows of cells, and the checked terms of a language pair."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.glossary import checked
from termweave.sources.markdown import parse

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _delimited(data: bytes) -> list[list[str]]:
    text = _text(data)
    head = next(iter(text.splitlines()), "")
    delimiter = max((",", ";", "\t"), key=head.count)
    return [[cell.strip() for cell in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]


def _first_table(data: bytes) -> list[list[str]] | None:
    return next(([[c.strip() for c in row] for row in block["rows"]] for block in parse(_text(data)) if block["kind"] == "table"), None)


def _first_sheet(data: bytes) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(book.read(names[0])).iter(f"{_SHEET}row"):
            number = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(number - len(rows))]
            for cell in row:
                column = 0
                for letter in re.match("[A-Z]*", cell.get("r", "")).group():
                    column = column * 26 + ord(letter) - 64
                value = cell.find(f"{_SHEET}v")
                if cell.get("t") == "inlineStr":
                    shown = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif value is None:
                    shown = ""
                else:
                    shown = shared[int(value.text)] if cell.get("t") == "s" else value.text or ""
                own = rows[number - 1]
                own += [""] * (max(column, len(own) + 1) - len(own))
                own[(column or len(own)) - 1] = shown.strip()
    return rows


def _read(name: str, data: bytes) -> tuple[list[list[str]], str | None]:
    """Rows of a file, and what is wrong with it."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind in ("csv", "tsv"):
        return _delimited(data), None
    if kind == "md":
        table = _first_table(data)
        return (table, None) if table else ([], "no_table")
    if kind == "xlsx":
        try:
            return _first_sheet(data), None
        except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
            return [], "broken_xlsx"
    return [], "unknown_type"


def glossary_rows(files: DataFrame) -> DataFrame:
    """name, row (from 1), cells, error for files (name, content) of type csv, tsv, xlsx or md.

    Cells are stripped; the first row is the header. The delimiter is the one of , ; and tab that the first line has
    most often. A file that can't be read is one row with an error and no cells. A file's rows lie in one batch: a
    glossary is small beside a corpus.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, data in zip(batch["name"], batch["content"], strict=True):
                rows, error = _read(name, bytes(data or b""))
                found += [(name, i, row, None) for i, row in enumerate(rows, 1)] or [(name, None, None, error)]
            yield pd.DataFrame(found, columns=["name", "row", "cells", "error"])

    return files.select("name", "content").mapInPandas(read, "name string, row int, cells array<string>, error string")


def language_pair(rows: DataFrame, source: str, target: str) -> DataFrame:
    """name, row, source, target, note of ``glossary_rows`` for two languages; a file without either has no rows.

    Headers count in lower case without outer white space; a column ``note`` is optional; short rows have empty cells.
    """
    header = rows.where("row = 1").select("name", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("header"))
    joined = rows.where("row > 1").join(header, "name")

    def cell(column: str):
        place = F.array_position("header", F.lit(column)).cast("int")
        return F.when(place > 0, F.coalesce(F.get("cells", place - 1), F.lit("")))

    found = joined.select("name", "row", cell(source).alias("source"), cell(target).alias("target"), F.coalesce(cell("note"), F.lit("")).alias("note"))
    return found.where("source is not null and target is not null")


def missing_languages(rows: DataFrame, source: str, target: str) -> DataFrame:
    """name, missing, known: files whose header lacks one of two languages, and the languages that it has."""
    header = rows.where("row = 1").select("name", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("header"))
    missing = F.filter(F.array(F.lit(source), F.lit(target)), lambda lang: ~F.array_contains("header", lang))
    known = F.filter("header", lambda c: (c != "") & (c != "note"))
    return header.select("name", missing.alias("missing"), known.alias("known")).where(F.size("missing") > 0)


def terms_and_issues(rows: DataFrame, source: str, target: str) -> DataFrame:
    """The rows of one file's language pair with their issue (null: a term in use)."""
    return checked(language_pair(rows, source, target))
