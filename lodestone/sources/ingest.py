"""From files and pages to chunks and tables: several kinds of files at once, typed tables of sheets, pages, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import script_language
from lodestone.operators.chunking import chunk
from lodestone.sources.readers import column_name, read_files, table_name, xlsx_rows

#: the kinds of a written value from narrow to wide
KINDS = ("long", "double", "boolean", "string")


def ingest(spark: SparkSession, path: str, kinds: list[str] | None = None, chunker: str = "window", extra: dict[str, str] | None = None, **options: int) -> DataFrame:
    """Chunks of all files of a folder: path, kind, chunk_index, n_chunks (of its text), chunk, n_chars and metadata."""
    found = chunk(read_files(spark, path, kinds), None, "text", chunker, carry=("path", "kind"), totals=True, **options)
    pairs = [F.lit("source"), F.element_at(F.split("path", "/"), -1), F.lit("kind"), F.col("kind")]
    pairs += [F.lit(x) for item in (extra or {}).items() for x in item]
    return found.select("path", "kind", "chunk_index", "n_chunks", "chunk", F.length("chunk").alias("n_chars"), F.create_map(*pairs).alias("metadata"))


def file_statistics(chunks: DataFrame) -> DataFrame:
    """path, kind, chunks and characters of each file; a file without text has no row."""
    return chunks.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("characters"))


def page_chunks(pages: DataFrame, page: str, text: str | Column, carry: Sequence[str] = (), **options: int) -> DataFrame:
    """Chunks of pages with their language, characters, and their place and number within the page; blank pages have none."""
    rows = pages.select(page, *carry, (F.col(text) if isinstance(text, str) else text).alias("__page"))
    out = chunk(rows, None, "__page", "window", carry=(page, *carry), totals=True, **options)
    return out.withColumns({"language": script_language("chunk"), "n_chars": F.length("chunk")})


def markdown_chunks(docs: DataFrame, doc_id: str, text: str, least: int = 50, size: int = 700, overlap: int = 100) -> DataFrame:
    """Sentence chunks of texts of at least so many characters; shorter ones go."""
    return chunk(docs.where(F.length(F.trim(text)) >= least), doc_id, text, "sentence", size=size, overlap=overlap)


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row (from 1) and cells of all spreadsheets of a folder; a broken file has no row."""
    cells = pa.list_(pa.string())

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = xlsx_rows(data.as_py() or b"")
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], cells)], ["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def column_kinds(rows: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The narrowest kind that reads every written value of a text column, found in one pass; string for an empty one."""
    written = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    fits = [F.bool_and(written(c).try_cast(k).isNotNull() | written(c).isNull()).alias(f"{i} {k}") for i, c in enumerate(columns) for k in KINDS[:3]]
    found = rows.agg(*fits, *(F.count(written(c)).alias(f"{i} n") for i, c in enumerate(columns))).first()
    return {c: next((k for k in KINDS[:3] if found[f"{i} n"] and found[f"{i} {k}"]), "string") for i, c in enumerate(columns)}


def sheet_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A typed table for each sheet with rows, named after its file and sheet, its columns after the first row.

    One header row for each sheet comes to the driver. Columns without a name are numbered, repeated names get their place.
    """
    rows, out = sheet_rows(spark, path), {}
    heads = rows.groupBy("path", "sheet").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    for r in heads.orderBy("path", "sheet").collect():
        names: list[str] = []
        for i, h in enumerate(r["head"]):
            name = column_name(h) if (h or "").strip() else f"column_{i + 1}"
            names.append(f"{name}_{i + 1}" if name.lower() in (x.lower() for x in names) else name)
        body = rows.where((F.col("path") == r["path"]) & (F.col("sheet") == r["sheet"]) & (F.col("row") > r["first"]))
        texts = body.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
        kinds = column_kinds(texts, names)
        table = table_name(r["path"], r["sheet"])
        while table in out:
            table += "_2"
        out[table] = texts.select(*(F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))).try_cast(kinds[n]).alias(n) for n in names))
    return out


def save_tables(tables: dict[str, DataFrame], database: str = "default") -> DataFrame:
    """Write every table in place of the one of its name; returns the catalogue: table, column, type and place."""
    columns = []
    spark = None
    for name, frame in tables.items():
        spark = frame.sparkSession
        frame.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
        columns += [(name, f.name, f.dataType.simpleString(), k) for k, f in enumerate(frame.schema.fields)]
    if spark is None:
        raise ValueError("no tables")
    return spark.createDataFrame(columns, "table string, column string, type string, place int")
