"""Values of loosely typed tables: first usable field, kinds, totals, synonyms, rows of text tables, sentences packed to a size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import whole_word


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_number(fields: Column, names: Sequence[str]) -> Column:
    """The first of the named fields of a map that reads as a number; a zero counts."""
    return F.coalesce(*(F.element_at(fields, n).try_cast("double") for n in names))


def amount(value: str | Column, unit: str | Column, rates: dict[str, float]) -> Column:
    """A value in the common unit: percents by 100, currencies by their rate, others as they are."""
    out = F.when(_c(unit) == "%", _c(value) / 100)
    for name, rate in rates.items():
        out = out.when(_c(unit) == name, _c(value) * rate)
    return out.otherwise(_c(value))


def valid_amount(value: str | Column, unit: str | Column, currencies: Sequence[str]) -> Column:
    """Percents lie in 0 to 100 and amounts of money are not negative."""
    return F.when(_c(unit) == "%", _c(value).between(0, 100)).when(_c(unit).isin(*currencies), _c(value) >= 0).otherwise(_c(value).isNotNull())


def conditional_totals(rows: DataFrame, value: str, kinds: dict[str, Column]) -> DataFrame:
    """The sum of all values and those of each kind, in one pass; one row."""
    return rows.agg(F.sum(value).alias("total"), *(F.sum(F.when(c, F.col(value))).alias(name) for name, c in kinds.items()))


def data_type(text: str | Column) -> Column:
    """integer, float, boolean or string of a written value; null for none."""
    t = F.trim(_c(text))
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(t.rlike(r"^[+-]?[0-9]+$"), "integer").when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").when(F.lower(t).isin("true", "false"), "boolean").otherwise("string")


def column_type(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The type of a column by its first value that is not empty; one row."""
    kind = data_type(F.col(column).cast("string"))
    return rows.where(kind.isNotNull()).agg(F.min_by(kind, order).alias("type"))


def scalar(value: str | Column, most: int = 5000) -> Column:
    """A list, map or struct as JSON of at most so many characters."""
    return F.substring(F.to_json(_c(value)), 1, most)


def with_synonyms(words: Column, synonyms: dict[str, Sequence[str]]) -> Column:
    """Distinct words with the synonyms of each, both ways; a small fixed table."""
    groups = F.array(*(F.array(F.lit(k), *(F.lit(v) for v in vs)) for k, vs in synonyms.items()))
    return F.array_sort(F.array_distinct(F.concat(words, F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, words))))))


def synonym_score(query: Column, question: Column, synonyms: dict[str, Sequence[str]], signals: Sequence[str]) -> Column:
    """Common words, half a point for each that only synonyms give, twice the Jaccard index, 1.5 for each common signal word."""
    common = F.array_intersect(query, question)
    wider = F.array_intersect(with_synonyms(query, synonyms), question)
    union = F.size(F.array_union(query, question))
    marks = F.size(F.array_intersect(common, F.array(*(F.lit(s) for s in signals))))
    return F.size(common) + 0.5 * (F.size(wider) - F.size(common)) + F.when(union > 0, 2 * F.size(common) / union).otherwise(0.0) + 1.5 * marks


def ordinal(text: str | Column, words: Sequence[str] = ("first", "second", "third", "fourth", "fifth")) -> Column:
    """The row that a text asks for by an ordinal word or a digit from 1 to 5, the smallest if there are several."""
    t = F.lower(_c(text))
    return F.coalesce(*(F.when(t.rlike(rf"{whole_word(w)}|(?<![0-9]){k}(?![0-9])"), k) for k, w in enumerate(words, 1)), F.lit(None).cast("int"))


def matching_rows(docs: DataFrame, doc_id: str, text: str, term: str, separator: str = r"\|") -> DataFrame:
    """The lines of each text that hold the term, numbered from 0, with their cells by position."""
    lines = docs.select(doc_id, F.posexplode(F.split(text, "\n")).alias("line", "__t")).where(F.lower("__t").contains(term.lower()))
    return lines.select(doc_id, "line", F.transform(F.split("__t", separator), lambda x: F.trim(x)).alias("cells"))


def nth_row(text: str | Column, k: int) -> Column:
    """The k-th line (from 1) of a text table; null beyond its end."""
    return F.try_element_at(F.split(_c(text), "\n"), F.lit(k))


def combined_keywords(*lists: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent keywords of several one-column tables together."""
    rows = lists[0].toDF("keyword")
    for more in lists[1:]:
        rows = rows.unionAll(more.toDF("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "keyword").limit(k)


def search_keywords(title: str | Column, numbers: Column, category: str | Column, most: int = 5) -> Column:
    """Title, the first numbers and category as one list without gaps."""
    return F.filter(F.concat(F.array(_c(title)), F.slice(numbers, 1, most), F.array(_c(category))), lambda x: x.isNotNull() & (x != ""))


def packed_sentences(text: str | Column, size: int = 500) -> Column:
    """Sentences packed one after the other into pieces of at most `size` characters, joined by ". "; a longer one stands alone."""
    parts = F.filter(F.transform(F.split(_c(text), r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, s: Column) -> Column:
        fits = F.length(state["open"]) + F.length(s) + 2 <= size
        joined = F.when(state["open"] == "", s).when(fits, F.concat(state["open"], F.lit(". "), s)).otherwise(s)
        done = F.when((state["open"] == "") | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), joined.alias("open"))

    return F.aggregate(parts, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def detailed_sources(retrieved: DataFrame, text: str, name: str, result: DataFrame, sample: int = 3) -> DataFrame:
    """Retrieved sources with at most 500 characters each, and one record of a structured query's result with sample rows."""
    rows = retrieved.select(F.lit("text").alias("type"), F.col(name).cast("string").alias("name"), F.substring(text, 1, 500).alias("content"), F.lit(None).cast("long").alias("rows"))
    order = result.columns
    # the sample is as small as its parameter
    few = result.orderBy(*order).limit(sample).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*order)))).alias("content"))
    record = result.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(few), F.lit(True)).select(F.lit("table").alias("type"), F.lit("result").alias("name"), "content", "rows")
    return rows.unionByName(record)


def distinct_tables(rows: DataFrame, table: str, header: str, body: str, first: int = 3) -> DataFrame:
    """One table of each content of header and first rows, that of the smallest name."""
    mark = F.sha2(F.concat_ws("\0", F.col(header), F.array_join(F.slice(body, 1, first), "\0")), 256)
    return rows.groupBy(mark.alias("mark")).agg(F.min(table).alias(table), F.count(F.lit(1)).alias("copies"))


def lookup(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell holds the value, in the first column whose name holds the given one or is held by it; ValueError without one."""
    plain = lambda c: c.lower().replace("_", "").replace(" ", "")
    found = next((c for c in rows.columns if plain(column) in plain(c) or plain(c) in plain(column)), None)
    if found is None:
        raise ValueError(f"no column like {column}")
    return rows.where(F.lower(F.col(found).cast("string")).contains(value.lower()))


def column_role(name: str) -> tuple[str, float]:
    """A column's role by its name: .95 for the whole name, .8 for a part of it, else text with .3."""
    roles = {"question": ("question", "query"), "answer": ("answer", "reply"), "year": ("year",), "date": ("date", "time", "ts"), "amount": ("price", "amount", "total", "balance", "acctbal", "value"), "code": ("code", "key", "id"), "title": ("title", "name")}
    parts = name.lower().replace("-", "_").split("_")
    for role, words in roles.items():
        if name.lower() in words:
            return role, 0.95
    for role, words in roles.items():
        if any(w in parts or any(p.endswith(w) and len(p) > len(w) for p in parts) for w in words):
            return role, 0.8
    return "text", 0.3


def dataset_type(columns: Sequence[str]) -> str:
    """qa, financial, legal, catalog or general, by the roles of the columns."""
    roles = {column_role(c)[0] for c in columns}
    if {"question", "answer"} <= roles:
        return "qa"
    if "amount" in roles:
        return "financial"
    if any("article" in c.lower() or "law" in c.lower() for c in columns):
        return "legal"
    return "catalog" if "title" in roles and "code" in roles else "general"
