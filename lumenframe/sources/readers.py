"""Readers: supported files of a folder as blocks, JSON lines, registries, event-stream frames."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.operators import blocks as bx

#: Suffixes that are rendered page by page, and those read as text.
RENDERED = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
TEXTUAL = (".txt", ".md", ".csv", ".docx", ".xlsx")


def supported(path: Column) -> Column:
    return fx.suffix(path).isin(*RENDERED, *TEXTUAL)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``filename``, ``suffix``, ``size_bytes``, ``sha256``, ``content`` of a folder's supported files, in any
    depth, in no order (sort by path where order matters). Content stays unread until a column needs it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = raw.where(supported(F.col("path")))
    return rows.select("path", fx.base_name(F.col("path")).alias("filename"), fx.suffix(F.col("path")).alias("suffix"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def text_pages(found: DataFrame) -> DataFrame:
    """Plain-text and markdown files as one page each: ``doc_id`` (the path), ``page``, ``text``, ``suffix``; bytes that are
    no UTF-8 become replacement characters."""
    rows = found.where(F.col("suffix").isin(".txt", ".md"))
    return rows.select(F.col("path").alias("doc_id"), F.lit(1).alias("page"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "suffix")


def csv_tables(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files as markdown blocks: ``doc_id``, ``block``, ``text``, ``section`` (the file's stem); quoted cells may hold
    commas, quotes and line ends."""
    import csv

    found = files(spark, folder).where("suffix = '.csv'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline="")))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "row_no", "cells"])

    rows = found.select("path", "content").mapInArrow(run, "doc_id string, row_no int, cells array<string>")
    return bx.markdown_tables(rows, ["doc_id"]).select("doc_id", "block", "text", fx.stem(F.col("doc_id")).alias("section"))


RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
XML_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """Values of a workbook's sheets: (sheet, row, cells); formulas give their stored values, empty cells ''."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).findall("m:si", XML_NS):
            shared.append("".join(t.text or "" for t in item.iter(f"{{{XML_NS['m']}}}t")))
    # A sheet's part is named by its relationship, whatever its number; without relationships parts are numbered.
    sheets = list(ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{{{XML_NS['m']}}}sheet"))
    links = {}
    if "xl/_rels/workbook.xml.rels" in archive.namelist():
        links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for number, sheet in enumerate(sheets, 1):
        name, target = sheet.get("name"), links.get(sheet.get(RELATION), f"worksheets/sheet{number}.xml")
        tree = ET.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for at, row in enumerate(tree.iter(f"{{{XML_NS['m']}}}row")):
            cells: list[str] = []
            for cell in row.findall("m:c", XML_NS):
                letters = "".join(ch for ch in cell.get("r", "") if ch.isalpha())
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                cells.extend([""] * (column - 1 - len(cells)))
                value, inline = cell.find("m:v", XML_NS), cell.find("m:is", XML_NS)
                if inline is not None:
                    cells.append("".join(t.text or "" for t in inline.iter(f"{{{XML_NS['m']}}}t")))
                elif value is None or value.text is None:
                    cells.append("")
                else:
                    cells.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
            out.append((name, at, cells))
    return out


def workbook_tables(spark: SparkSession, folder: str) -> DataFrame:
    """XLSX files as markdown blocks, a table a sheet: ``doc_id``, ``section`` (the sheet), ``block``, ``text``."""
    found = files(spark, folder).where("suffix = '.xlsx'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = sheet_rows(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["doc_id", "section", "row_no", "cells"])

    rows = found.select("path", "content").mapInArrow(run, "doc_id string, section string, row_no int, cells array<string>")
    return bx.markdown_tables(rows, ["doc_id", "section"]).select("doc_id", "section", "block", "text")


def word_blocks(content: bytes) -> list[tuple[int, str, str, str]]:
    """A word-processor file's paragraphs and tables in order: (ord, kind, text, section); heading and title styles set
    the section."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find("w:body", XML_NS)
    w = f"{{{XML_NS['w']}}}"
    say = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    out, section = [], ""
    for node in body if body is not None else ():
        if node.tag == f"{w}p" and say(node):
            style = node.find("w:pPr/w:pStyle", XML_NS)
            name = (style.get(f"{w}val") if style is not None else "").lower()
            heading = name.startswith(("heading", "title"))
            section = say(node) if heading else section
            out.append((len(out), "heading" if heading else "paragraph", say(node), section))
        elif node.tag == f"{w}tbl":
            rows = [[say(cell).replace("|", "\\|").replace("\n", " ") for cell in row.findall("w:tc", XML_NS)] for row in node.findall("w:tr", XML_NS)]
            rows = [r for r in rows if any(r)]
            width = max(map(len, rows), default=0)
            lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
            if lines:
                lines.insert(1, f"| {' | '.join(['---'] * width)} |")
                out.append((len(out), "table", "\n".join(lines), section))
    return out


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """DOCX files as blocks: ``doc_id``, ``ord``, ``kind``, ``text``, ``section``."""
    found = files(spark, folder).where("suffix = '.docx'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = word_blocks(content)
                kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(4))], names=["doc_id", "ord", "kind", "text", "section"])

    return found.select("path", "content").mapInArrow(run, "doc_id string, ord int, kind string, text string, section string")


def folder_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all textual files of a folder, each read by its suffix: ``doc_id``, ``ord``, ``kind``, ``text``,
    ``section``. Markdown has headings and tables, plain text paragraphs only."""
    pages = text_pages(files(spark, folder))
    plain = bx.plain_blocks(pages.where("suffix = '.txt'")).unionByName(bx.plain_blocks(pages.where("suffix = '.md'"), markdown=True)).select("doc_id", "ord", "kind", "text", "section")
    as_table = lambda df: df.select("doc_id", F.col("block").alias("ord"), F.lit("table").alias("kind"), "text", "section")
    return plain.unionByName(as_table(csv_tables(spark, folder))).unionByName(as_table(workbook_tables(spark, folder))).unionByName(document_blocks(spark, folder).select("doc_id", "ord", "kind", "text", "section"))


def json_lines(spark: SparkSession, path: str, schema: str, needed: str | None = None) -> DataFrame:
    """JSON lines with a stated schema; blank and broken lines are skipped, and rows whose ``needed`` field is missing or
    a placeholder."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")
    return rows if needed is None else rows.where(F.col(needed).isNotNull() & (F.upper(F.col(needed).cast("string")) != "PLACEHOLDER"))


def frames(streams: DataFrame, joined: bool = True) -> DataFrame:
    """Events of server-sent streams (``stream_id``, ``body``): ``stream_id``, ``seq``, ``data`` (JSON text), ``good``. Frames
    end at blank lines. ``joined``: a frame's data lines are one document; else each line is its own."""
    parts = streams.select("stream_id", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("frame", "text"))
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^data:[ ]?(.*?)\r?$"), 1)
    data = F.array(F.array_join(lines, "\n")) if joined else lines
    rows = parts.select("stream_id", "frame", F.posexplode(data).alias("line", "data")).where("data <> ''")
    from pyspark.sql import Window

    order = Window.partitionBy("stream_id").orderBy("frame", "line")
    return rows.select("stream_id", F.row_number().over(order).alias("seq"), "data", F.try_parse_json("data").isNotNull().alias("good"))


def registry(spark: SparkSession, entries: list[dict], defaults: dict) -> DataFrame:
    """A small registry (models, tools) as a table, each entry over the defaults."""
    return spark.createDataFrame([defaults | e for e in entries])
