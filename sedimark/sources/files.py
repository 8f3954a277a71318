"""Attachments: delimited text, Markdown, workbooks and office documents, parsed a file a task."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, sheet_index int, row_index int, col_index int, cell_ref string, value_type string, formula string, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def decoded(content: bytes) -> str:
    """Text by its mark, else UTF-8, else GB18030."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gb18030", "replace")


def column_of(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, sheet_index, row, column, ref, type, formula, value) of a workbook's cells, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for _, item in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if item.tag == _MAIN + "si":
                    shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
                    item.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for index, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")):
            target = targets[sheet.get(_REL + "id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, cell in ElementTree.iterparse(f):
                    if cell.tag != _MAIN + "c":
                        continue
                    ref, kind = cell.get("r"), cell.get("t", "n")
                    value, formula = cell.find(_MAIN + "v"), cell.find(_MAIN + "f")
                    text = value.text if value is not None else None
                    if kind == "s" and text is not None:
                        text, kind = shared[int(text)], "str"
                    elif kind == "inlineStr":
                        text, kind = "".join(t.text or "" for t in cell.iter(_MAIN + "t")), "str"
                    if text is not None or formula is not None:
                        yield sheet.get("name"), index, int(re.sub(r"\D", "", ref)), column_of(ref), ref, kind, "=" + formula.text if formula is not None and formula.text else None, text
                    cell.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks below path: formula and cached value of each."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *cell) for cell in workbook_cells(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return binary_files(spark, path, "*.xlsx").mapInPandas(work, CELLS)


def workbook_summary(cells: DataFrame) -> DataFrame:
    """Used range and counts of each sheet."""
    return cells.groupBy("path", "sheet", "sheet_index").agg(
        F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.count_if(F.col("value_type") == "e").alias("errors"), F.count_if(F.col("formula").isNotNull() & F.col("value").isNull()).alias("uncached"),
        F.max("row_index").alias("rows"), F.max("col_index").alias("columns"),
    )


def workbook_search(cells: DataFrame, query: str) -> DataFrame:
    """Cells whose value has the query, any case, in sheet, row and column order."""
    return cells.filter(F.contains(F.lower("value"), F.lit(query.lower()))).orderBy("path", "sheet_index", "row_index", "col_index")


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """path, block_no and text of the paragraphs of Word documents below path."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                texts = ["".join(t.text or "" for t in p.iter(_WORD + "t")) for p in body.iter(_WORD + "p")]
                rows = [(name, i, t) for i, t in enumerate(texts) if t.strip()]
                yield pd.DataFrame(rows, columns=["path", "block_no", "text"])

    return binary_files(spark, path, "*.docx").mapInPandas(work, "path string, block_no int, text string")


_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """path, slide, part (slide or notes) and text of the slides below path."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        m = re.fullmatch(r"ppt/(slides|notesSlides)/(?:slide|notesSlide)(\d+)\.xml", member)
                        if m:
                            paragraphs = ElementTree.fromstring(z.read(member)).iter(_DRAW + "p")
                            text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(_DRAW + "t")).strip() for p in paragraphs)))
                            rows.append((name, int(m[2]), "slide" if m[1] == "slides" else "notes", text))
            yield pd.DataFrame(sorted(rows), columns=["path", "slide", "part", "text"])

    return binary_files(spark, path, "*.pptx").mapInPandas(work, "path string, slide int, part string, text string")


def delimited_rows(text: str, sample: int = 16_384) -> Iterator[list[str]]:
    """Rows of delimited text, short ones filled up.

    The separator is that of comma, semicolon, tab and bar which gives most lines of
    the sample the same number of fields, more than one of them.
    """
    head = text[:sample].splitlines()[:-1] or text.splitlines()

    def agreement(mark: str) -> tuple[int, int]:
        widths = Counter(len(r) for r in csv.reader(head, delimiter=mark) if len(r) > 1)
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return n, width

    rows = [r for r in csv.reader(io.StringIO(text), delimiter=max(",;\t|", key=agreement)) if any(v.strip() for v in r)]
    width = max(map(len, rows), default=0)
    return (r + [""] * (width - len(r)) for r in rows)


def markdown_sections(text: str) -> list[tuple[int, str, str]]:
    """(first line, heading path, text) of each section; fences hide headings."""
    stack: list[tuple[int, str]] = []
    out, lines, start, fence = [], [], 1, None

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((start, " > ".join(h for _, h in stack), body))
        lines.clear()

    for n, line in enumerate(text.splitlines(), 1):
        mark = re.match(r"\s*(```|~~~)", line)
        if mark and (fence is None or fence == mark[1]):
            fence = mark[1] if fence is None else None
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line) if fence is None and not mark else None
        if heading:
            close()
            level = len(heading[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, heading[2]))
            start = n
        else:
            if not lines:
                start = n
            lines.append(line)
    close()
    return out


CHUNKS = "path string, chunk_no int, line_no int, heading string, text string"


def read_attachments(spark: SparkSession, path: str, max_chars: int = 4000) -> DataFrame:
    """Chunks of csv, md and txt files below path, each with its place in the file."""

    def chunks(name: str, content: bytes) -> Iterator[tuple]:
        text = decoded(content)
        if name.lower().endswith(".csv"):
            parts = [(i, "", " | ".join(r)) for i, r in enumerate(delimited_rows(text), 1)]
        elif name.lower().endswith(".md"):
            parts = markdown_sections(text)
        else:
            parts = [(i, "", line) for i, line in enumerate(text.splitlines(), 1) if line.strip()]
        held, size, first = [], 0, None
        for line, heading, body in parts:
            if held and (size + len(body) + 1 > max_chars or first[1] != heading):
                yield (*first, "\n".join(held))
                held, size = [], 0
            if not held:
                first = (line, heading)
            held.append(body)
            size += len(body) + 1
        if held:
            yield (*first, "\n".join(held))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, i, *c) for i, c in enumerate(chunks(name, content))], columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return binary_files(spark, path, "*.{csv,md,txt}").mapInPandas(work, CHUNKS)
