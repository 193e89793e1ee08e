"""Readers: one frame of documents from files of a kind, by Spark's own readers where there is one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.web import html_text
from lodestone.sources.pdf import pdf_pages

ENCODINGS = ("utf-8", "windows-1256", "latin-1")


def row_text(columns: list[str]) -> Column:
    """'col: value' of every non-null cell, joined by ' | '."""
    return F.concat_ws(" | ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def _decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def docx_text(data: bytes) -> str:
    """Headings (with #), paragraphs and tables (a line per row) of a Word file in its order, joined by empty lines; empty if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    written = lambda x: "".join(t.text or "" for t in x.iter(f"{w}t"))
    body, out = root.find(f"{w}body"), []
    for block in root if body is None else body:
        if block.tag == f"{w}tbl":
            out.append("\n".join(" | ".join(written(c).strip() for c in row.findall(f"{w}tc")) for row in block.findall(f"{w}tr")))
        else:
            style = block.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{w}val") or "") if style is not None else None
            text = written(block)
            out.append(f"{'#' * int(level[1])} {text}" if level and text.strip() else text)
    return "\n\n".join(p for p in out if p.strip())


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a spreadsheet; none if it isn't one."""
    n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            shared = ["".join(t.text or "" for t in s.iter(f"{n}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{n}si")] if "xl/sharedStrings.xml" in names else []
            out = []
            for name in sorted(x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
                for k, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{n}row"), 1):
                    cells = []
                    for c in row.iter(f"{n}c"):
                        v = c.find(f"{n}v")
                        inline = "".join(t.text or "" for t in c.iter(f"{n}t"))
                        cells.append(shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else inline)
                    out.append((name[14:-4], k, cells))
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return []


def binary_text(spark: SparkSession, path: str, parse: Callable[[bytes], str], glob: str) -> DataFrame:
    """path and text of binary files by a parser that runs on the executors."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(b or b"") for b in batch.column(1).to_pylist()], pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files; bytes that are no UTF-8 are read in the next encoding."""
    return binary_text(spark, path, _decode, "*.txt")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown without its marks."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    t = F.regexp_replace("text", r"(?m)^#{1,6}\s*|^\s*>\s?", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return rows.select("path", F.regexp_replace(t, r"[*_`]{1,3}", "").alias("text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", "*.htm*").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), html_text("value").alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A document per row."""
    rows = spark.read.csv(path, header=True, inferSchema=True, pathGlobFilter="*.csv")
    return rows.select(F.col("_metadata.file_path").alias("path"), row_text(rows.columns).alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document per element of a list, or one of an object."""
    rows = spark.read.json(path, multiLine=True, pathGlobFilter="*.json")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.to_json(F.struct(*rows.columns)).alias("text"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return binary_text(spark, path, docx_text, "*.docx")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A text per file, with a line per row under the first row's names."""

    def lines(data: bytes) -> str:
        out, names = [], {}
        for sheet, k, cells in xlsx_rows(data):
            if k == 1:
                names[sheet] = cells
            else:
                head = names.get(sheet, [])
                out.append(" | ".join(f"{head[i] if i < len(head) else i}: {c}" for i, c in enumerate(cells) if c))
        return "\n".join(out)

    return binary_text(spark, path, lines, "*.xlsx")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A text per file, its pages joined by empty lines."""
    return binary_text(spark, path, lambda data: "\n\n".join(p for p in pdf_pages(data) if p), "*.pdf")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": read_text, "md": read_markdown, "html": read_html, "csv": read_csv, "json": read_json, "docx": read_docx, "xlsx": read_xlsx, "pdf": read_pdf}


def read_files(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """path, kind and text of the files of a folder, one reader per extension."""
    out = None
    for kind in kinds or [*READERS]:
        part = READERS[kind](spark, path).select("path", F.lit(kind).alias("kind"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def column_name(name: str) -> str:
    """A name for SQL: other characters as _, none doubled or at the ends."""
    return re.sub(r"_+", "_", re.sub(r"\W", "_", name)).strip("_") or "column"


def table_name(file: str, sheet: str) -> str:
    return column_name(f"{file.rsplit('/', 1)[-1].rsplit('.', 1)[0]}_{sheet}").lower()


def pdf_kind(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """text, image or hybrid by the first five pages' share of texts over 50 characters and their mean length."""
    stats = pages.where(F.col(page) < 5).groupBy(doc).agg(F.avg((F.length(text) > 50).cast("double")).alias("share"), F.avg(F.length(text)).alias("mean"))
    return stats.select(doc, F.when((F.col("share") >= 0.8) & (F.col("mean") > 200), "text").when((F.col("share") <= 0.2) | (F.col("mean") < 100), "image").otherwise("hybrid").alias("kind"))
