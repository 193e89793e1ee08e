"""Sections, codes, headers and layouts of tables and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import code_level, digit_runs


def islands(rows: DataFrame, by: Sequence[str], order: str, is_header: Column) -> DataFrame:
    """The rows with a section number: each header starts one, rows before the first are section 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.sum(is_header.cast("int")).over(w))


def codes(docs: DataFrame, doc_id: str, text: str, digits: int = 6) -> DataFrame:
    """doc_id, code and level of the distinct codes of each text."""
    return docs.select(F.col(doc_id), F.explode(digit_runs(text, digits, digits)).alias("code")).withColumn("level", code_level("code"))


def sections_with_clauses(found: DataFrame) -> DataFrame:
    """Every section with its clauses and their number; a clause without a section stays at the top."""
    all_codes = found.select("code", "level").distinct()
    section = all_codes.where(F.col("level").isin("part", "section")).select(F.col("code").alias("section"))
    clause = all_codes.where(F.col("level").isin("clause", "item")).select(F.col("code").alias("clause"), F.concat(F.substring("code", 1, 3), F.lit("000")).alias("up"))
    joined = section.join(clause, section["section"] == clause["up"], "full_outer")
    return joined.groupBy(F.coalesce("section", "clause").alias("code")).agg(F.count(F.when(F.col("section").isNotNull(), F.col("clause"))).alias("clauses"), F.max(F.col("section").isNull()).alias("orphan"))


def header_rows(cells: DataFrame, table: str, row: str, cell: str, most: int = 5) -> DataFrame:
    """table and the number (1 to most) of leading rows with more text cells than numeric ones."""
    number = F.translate(F.col(cell), ",", "").try_cast("double").isNotNull()
    kinds = cells.where(F.trim(cell) != "").groupBy(table, row).agg(F.count_if(~number).alias("texts"), F.count_if(number).alias("numbers"))
    first = kinds.groupBy(table).agg(F.min(F.when(F.col("texts") <= F.col("numbers"), F.col(row))).alias("stop"), F.count(F.lit(1)).alias("n"), F.min(row).alias("start"))
    return first.select(table, F.greatest(F.lit(1), F.least(F.coalesce(F.col("stop") - F.col("start"), F.col("n")), F.lit(most))).cast("int").alias("headers"))


def header_path(levels: str | Column) -> Column:
    """Non-empty header cells of a column as '[Lk]title' joined by ' > '."""
    c = F.col(levels) if isinstance(levels, str) else levels
    marked = F.transform(c, lambda x, i: F.when(F.trim(x) != "", F.concat(F.lit("[L"), (i + 1).cast("string"), F.lit("]"), F.trim(x))))
    return F.array_join(marked, " > ")


def table_quality(ragged: Column, empty_share: Column, rows: Column, has_letters: Column) -> Column:
    """1 less penalties for ragged rows, empty cells, no letters and few rows; at least 0."""
    penalty = F.when(ragged, 0.3).otherwise(0.0) + F.when(empty_share > 0.5, 0.4).when(empty_share > 0.3, 0.2).otherwise(0.0) + F.when(~has_letters, 0.2).otherwise(0.0) + F.when(rows < 3, 0.3).otherwise(0.0)
    return F.greatest(1 - penalty, F.lit(0.0))


def nearest_title(codes_at: DataFrame, titles: DataFrame, by: str, code_col: str, title_col: str, title: str) -> DataFrame:
    """For each code of a row the title with the smallest column distance; the leftmost on a tie."""
    pairs = codes_at.join(titles, by)
    return pairs.groupBy(by, code_col).agg(F.min_by(title, F.struct(F.abs(F.col(code_col) - F.col(title_col)), F.col(title_col))).alias("title"))


def layout_region(y: Column, height: Column, header: float = 0.13, footer: float = 0.90) -> Column:
    share = y / height
    return F.when(share <= header, "header").when(share >= footer, "footer").otherwise("body")


def running_lines(boxes: DataFrame, page: str, region: str, text: str) -> DataFrame:
    """Boxes without texts that recur (digits aside) in the header or footer of two pages, and without lone page numbers."""
    key = F.trim(F.regexp_replace(text, "[0-9]+", ""))
    rows = boxes.withColumn("__key", key)
    edge = rows.where(F.col(region).isin("header", "footer"))
    repeated = edge.groupBy(region, "__key").agg(F.count_distinct(page).alias("n")).where("n >= 2").select(region, "__key")
    kept = rows.join(repeated, [region, "__key"], "left_anti")
    return kept.where(~(F.col(region).isin("header", "footer") & F.trim(text).rlike(r"^[0-9]+$"))).select(*boxes.columns)


def cell_search(cells: DataFrame, table: str, row: str, col: str, cell: str, query: str) -> DataFrame:
    """Where a text occurs in a table's cells."""
    return cells.where(F.lower(cell).contains(query.lower())).select(table, row, col, cell)


def token_column(text: str | Column, k: int) -> Column:
    """The k-th (from 0) space-separated token of a line."""
    t = F.col(text) if isinstance(text, str) else text
    return F.get(F.split(F.trim(t), r"\s+"), k)


def content_class(text: str | Column, patterns: dict[str, str]) -> Column:
    """The type with the most matches (struct of n and type), general without any; ties go to the name that sorts last."""
    t = F.col(text) if isinstance(text, str) else text
    best = F.array_max(F.array(*(F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(k).alias("type")) for k, p in patterns.items())))
    return F.struct(F.when(best["n"] > 0, best["type"]).otherwise("general").alias("type"), best["n"].alias("n"))


def text_lines(boxes: DataFrame, page: str, share: float = 0.6, least: float = 8.0) -> DataFrame:
    """Lines of OCR boxes (page, text, x1, y1, x2, y2): a box joins the line whose first box's centre is within a share of the
    median height; boxes of a line run from right to left. One page's boxes fit a task by nature."""

    def run(pdf):
        pdf = pdf.assign(cy=(pdf.y1 + pdf.y2) / 2, cx=(pdf.x1 + pdf.x2) / 2).sort_values(["cy", "cx"])
        near = max(least, share * float((pdf.y2 - pdf.y1).median()))
        line, anchor, lines = -1, None, []
        for cy in pdf.cy:
            if anchor is None or cy - anchor > near:
                line, anchor = line + 1, cy
            lines.append(line)
        pdf = pdf.assign(line=lines).sort_values(["line", "cx"], ascending=[True, False])
        out = pdf.groupby("line").text.agg(lambda t: " ".join(x for x in t if x)).reset_index()
        out.insert(0, page, pdf[page].iloc[0])
        return out

    kind = dict(boxes.dtypes)[page]
    return boxes.select(page, "text", "x1", "y1", "x2", "y2").groupBy(page).applyInPandas(run, f"{page} {kind}, line int, text string")
