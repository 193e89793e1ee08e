"""What answers are made of: citations, tables and JSON in free text, typed patterns, summaries, chart series, chunks of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.similarity import jaccard, sequence_ratio
from lodestone.sources.scratch import stash

NEAR = 50  # characters on both sides of a pattern's start in which its cue words count


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_object(text: str | Column) -> Column:
    """The JSON in free text: of the first fence, else the whole, else from the first to the last brace; null without any."""
    t = F.trim(_c(text))
    fence = F.when(t.contains("```json"), "```json").when(t.contains("```"), "```")
    inner = F.trim(F.coalesce(F.split_part(F.substring(t, F.instr(t, fence) + F.length(fence), F.length(t)), F.lit("```"), F.lit(1)), t))
    outer = F.nullif(F.regexp_extract(inner, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(inner), valid(outer))


def split_table(text: str | Column) -> Column:
    """struct<table, prose>: the first block of lines with bars and the trimmed text around it; null where there is no table."""
    t = _c(text)
    block = F.regexp_extract(t, r"\| [^\n]*(?:\n[ \t]*\|[^\n]*)*", 0)
    start = F.instr(t, "| ")
    around = F.array(F.substring(t, F.lit(1), start - 1), F.substring(t, start + F.length(block), F.length(t)))
    prose = F.array_join(F.filter(F.transform(around, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n\n")
    return F.when(start > 0, F.struct(block.alias("table"), F.nullif(prose, F.lit("")).alias("prose")))


def unmapped_citations(answer: str | Column, context: str | Column, patterns: Sequence[str]) -> Column:
    """Citations of the answer that the context lacks, lower-cased, sorted, each once; patterns match words and their numbers."""
    found = lambda x: F.flatten(F.array(*(F.regexp_extract_all(F.lower(_c(x)), F.lit(f"({p})")) for p in patterns)))
    return F.array_sort(F.array_except(found(answer), found(context)))


def citation_score(missing: str | Column) -> Column:
    """1 where every citation is mapped (or there is none), else .5."""
    return F.when(F.size(_c(missing)) > 0, 0.5).otherwise(1.0)


def context_metrics(retrieved: Column, truth: Column, least: float = 0.7, top: int = 5) -> Column:
    """struct<precision, recall, mrr> of ranked contexts against true ones, both arrays of word arrays.

    Two contexts are the same when their Jaccard index is at least `least`. Nothing retrieved scores 0, and so does an empty truth.
    """
    same = lambda a, b: jaccard(a, b) >= least
    hits = F.transform(retrieved, lambda r: F.exists(truth, lambda g: same(r, g)))
    in_top = F.size(F.filter(F.slice(hits, 1, top), lambda h: h))
    back = F.size(F.filter(truth, lambda g: F.exists(retrieved, lambda r: same(r, g))))
    first = F.array_position(hits, True)
    precision = F.when(F.size(retrieved) > 0, in_top / F.least(F.size(retrieved), F.lit(top))).otherwise(0.0)
    return F.struct(
        precision.alias("precision"),
        F.when((F.size(truth) > 0) & (F.size(retrieved) > 0), back / F.size(truth)).otherwise(0.0).alias("recall"),
        F.when(first > 0, 1 / first).otherwise(0.0).alias("mrr"),
    )


def batch_average(cases: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The number of cases and the mean of each metric; one row."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), *(F.avg(m).alias(m) for m in metrics))


def keyword_similarity(docs: DataFrame, doc_id: str, text: str, terms: Sequence[str], least: float = 0.8, most: int = 20_000) -> DataFrame:
    """doc_id, keyword_score (share of terms that some word resembles) and score (.4 mean ratio + .6 that share).

    A stated set of terms against every distinct word of the documents: the ratio is reckoned once for a word, not once for
    each place it stands. At most `most` such words are counted and broadcast, so that the documents' words stay where they are;
    more are merged. Documents that no term resembles have no row.
    """
    words = docs.select(doc_id, F.explode(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))).alias("word"))
    given = F.array(*(F.lit(t) for t in terms))
    near = words.select("word").distinct().select("word", F.explode(given).alias("term"))
    # the ratio of two strings is at most twice the shorter over the sum of lengths
    shorter, both = F.least(F.length("word"), F.length("term")), F.length("word") + F.length("term")
    near = near.where(2 * shorter >= least * both).withColumn("ratio", sequence_ratio("term", "word")).where(F.col("ratio") >= least)
    near = stash(near, "similar_words")
    best = words.join(F.broadcast(near) if near.count() <= most else near.hint("merge"), "word").groupBy(doc_id, "term").agg(F.max("ratio").alias("ratio"))
    out = best.groupBy(doc_id).agg(F.avg("ratio").alias("mean"), (F.count(F.lit(1)) / len(terms)).alias("keyword_score"))
    return out.select(doc_id, "keyword_score", (0.4 * F.col("mean") + 0.6 * F.col("keyword_score")).alias("score"))


def typed_patterns(docs: DataFrame, doc_id: str, text: str, patterns: Sequence[tuple[str, str]], cues: dict[str, Sequence[str]], margin: int = 20) -> DataFrame:
    """Every match of the (type, pattern) pairs: its place, value, surroundings and confidence.

    The confidence is .7, and .1 more for each cue word of the type near the match, .99 at most. Places are code points, the
    end is exclusive. Texts stream through in batches, since no built-in expression gives the places of all matches.
    """
    compiled = [(k, re.compile(p, re.IGNORECASE)) for k, p in patterns]
    schema = "doc_id long, type string, value string, start int, end int, around string, confidence double"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, pattern in compiled:
                    for m in pattern.finditer(body or ""):
                        near = body[max(0, m.start() - NEAR) : m.start() + NEAR].lower()
                        sure = min(0.99, 0.7 + 0.1 * sum(c in near for c in cues.get(kind, ())))
                        rows.append((key, kind, m[0], m.start(), m.end(), body[max(0, m.start() - margin) : m.end() + margin], sure))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def pattern_class(text: str | Column, patterns: dict[str, str]) -> Column:
    """struct<n, type, confidence>: the type with the most matches, the last name of equal ones; a third for each match, 1 at most."""
    t = F.lower(_c(text))
    best = F.array_max(F.array(*(F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(k).alias("type")) for k, p in patterns.items())))
    return F.when(best["n"] > 0, F.struct(best["n"].alias("n"), best["type"].alias("type"), F.least(best["n"] / 3, F.lit(1.0)).alias("confidence")))


def content_bonus(score: Column, query: Column, content: Column, wants: Sequence[tuple[str, str]]) -> Column:
    """A score with .1 for the query's whole phrase, .05 for each (asked, given) pair of patterns that both hold; 1 at most."""
    q, c = F.lower(query), F.lower(content)
    bonus = F.when(c.contains(q), 0.1).otherwise(0.0)
    for asked, given in wants:
        bonus = bonus + F.when(q.rlike(asked) & c.rlike(given), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), score + bonus)


def answer_totals(rows: DataFrame, item: str, year: str, value: str) -> DataFrame:
    """Sums by item, by year and of all rows, in one pass; `by` names the grouping. Sorting and rendering are left to the caller."""
    grouped = rows.groupingSets([[F.col(item)], [F.col(year)], []], F.col(item), F.col(year)).agg(F.grouping_id().alias("g"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    by = F.when(F.col("g") == 1, "item").when(F.col("g") == 2, "year").otherwise("all")
    return grouped.select(by.alias("by"), F.coalesce(F.col(item).cast("string"), F.col(year).cast("string")).alias("value"), "total", "n")


def list_summary(rows: DataFrame, title: str) -> DataFrame:
    """The number of rows and the most common title, the first by name of equal ones; one row."""
    counts = rows.groupBy(F.col(title).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("title").isNotNull(), F.struct(-F.col("n"), F.col("title")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min_by("title", named).alias("title"))


def best_covered(rows: DataFrame, entity: str, period: str, asked: Sequence, least: int = 2) -> DataFrame:
    """The entity that covers most of the asked periods, then has most rows, then comes first; no row where it covers too few."""
    stats = rows.where(F.col(period).isin(*asked)).groupBy(entity).agg(F.count_distinct(period).alias("covered"), F.count(F.lit(1)).alias("n"))
    return stats.where(F.col("covered") >= least).orderBy(F.desc("covered"), F.desc("n"), entity).limit(1)


def chart_series(rows: DataFrame, key: str, label: str, series: Sequence[str], most: int = 5) -> DataFrame:
    """Points of a chart: key, label, series, value (0 where none); at most `most` series. Rows are not gathered."""
    points = F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.coalesce(F.col(s).try_cast("double"), F.lit(0.0)).alias("value")) for s in series[:most])))
    return rows.select(key, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), points.alias("p")).select(key, "label", "p.series", "p.value")


def table_chunks(rows: DataFrame, page: str, index: str, header: Sequence[str]) -> DataFrame:
    """page, row (0 for the headers) and text: one chunk for a table's headers, one for each row with its headers; empty cells go."""
    place = F.concat(F.lit("Page "), F.col(page).cast("string"))
    names = F.lit("\nHeaders:\n" + "".join(f"  Column {i}: {h}\n" for i, h in enumerate(header)))
    cells = F.array(*(F.when(F.trim(F.col(h).cast("string")) != "", F.concat(F.lit(f"  {h}: "), F.col(h).cast("string"), F.lit("\n"))) for h in header))
    heads = rows.select(page).distinct().select(page, F.lit(0).cast("long").alias("row"), F.concat(place, names).alias("text"))
    body = rows.select(page, F.col(index).cast("long").alias("row"), F.concat(place, F.lit(", Row "), F.col(index).cast("string"), F.lit("\n"), F.array_join(cells, "")).alias("text"))
    return heads.unionByName(body)


def code_levels(rows: DataFrame, code: str, value: str, widths: Sequence[int]) -> DataFrame:
    """Sums at every level of codes of one length: a level keeps so many digits of a code and fills the rest with zeros."""
    own = rows.groupBy(F.col(code).alias("code")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.rpad(F.substring("code", 1, w), F.length("code"), F.lit("0")).alias("code")) for k, w in enumerate(widths)))
    return own.select(F.explode(levels).alias("l"), "total", "n").groupBy("l.level", "l.code").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def qa_documents(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """Rows of questions and answers as documents: both in `text`, the question also as metadata; rows without either go."""
    full = lambda c: F.length(F.trim(F.col(c))) > 0
    text = F.concat(F.trim(question), F.lit("\n"), F.trim(answer))
    return rows.where(full(question) & full(answer)).withColumns({"text": text, "metadata": F.create_map(F.lit("question"), F.trim(question))})
