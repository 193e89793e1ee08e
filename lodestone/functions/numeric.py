"""Numbers, years and codes in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_digits


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(text: str | Column) -> Column:
    """A number in any digit script, with commas for thousands; null otherwise. A trailing % divides by 100."""
    t = F.trim(ascii_digits(text))
    bare = F.regexp_replace(t, r"[,%\s]", "").try_cast("double")
    return F.when(t.endswith("%"), bare / 100).otherwise(bare)


def numbers(text: str | Column) -> Column:
    """All numbers of a text in order, thousands commas removed."""
    found = F.regexp_extract_all(ascii_digits(text), F.lit(r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"))
    return F.filter(F.transform(found, lambda x: F.translate(x, ",", "").try_cast("double")), lambda x: x.isNotNull())


def digit_runs(text: str | Column, low: int = 1, high: int = 40) -> Column:
    """Distinct runs of low to high digits that stand alone, in order."""
    return F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(rf"(?<![0-9])([0-9]{{{low},{high}}})(?![0-9])")))


def dominant_digits(text: str | Column, low: int = 3, high: int = 8) -> Column:
    """The commonest length of digit runs, the shorter on a tie; null without any."""
    counts = [F.struct(F.size(F.regexp_extract_all(ascii_digits(text), F.lit(rf"(?<![0-9])([0-9]{{{k}}})(?![0-9])"))).alias("n"), F.lit(-k).alias("k")) for k in range(low, high + 1)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, -best["k"])


def last_code(text: str | Column, digits: int = 6) -> Column:
    found = F.regexp_extract_all(_c(text), F.lit(rf"(?<![0-9])([0-9]{{{digits}}})(?![0-9])"))
    return F.try_element_at(found, F.lit(-1))


def year_token(token: str | Column) -> Column:
    """A solar year from four, three or two digits: 1300-1499; 300-499 and 1000 more; from 50 in 1300, below in 1400."""
    n = ascii_digits(token).try_cast("int")
    size = F.length(F.trim(_c(token)))
    return F.when((size == 4) & n.between(1300, 1499), n).when((size == 3) & n.between(300, 499), n + 1000).when((size == 2) & (n >= 50), n + 1300).when((size == 2) & (n >= 0), n + 1400)


def solar_years(text: str | Column) -> Column:
    """Distinct years named in a text, sorted; a range (a - b, a تا b) gives every year in it."""
    t = ascii_digits(text)
    pairs = F.regexp_extract_all(t, F.lit(r"(?<![0-9])([0-9]{2,4}\s*(?:-|تا)\s*[0-9]{2,4})(?![0-9])"))
    ends = F.transform(pairs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"([0-9]+)")), year_token))
    spans = F.transform(F.filter(ends, lambda e: e[0].isNotNull() & e[1].isNotNull() & (e[1] >= e[0])), lambda e: F.sequence(e[0], e[1]))
    single = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?<![0-9])([0-9]{2,4})(?![0-9])")), year_token), lambda y: y.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.flatten(spans), single)))


def in_range(values: str | Column, low: float, high: float) -> Column:
    return F.filter(_c(values), lambda v: v.between(low, high))


def numeric_match(query: str | Column, found: str | Column) -> Column:
    """Query numbers found within .01 as a whole, within a tenth as a half, over the query's numbers; capped at 1."""
    q, d = _c(query), _c(found)
    score = F.aggregate(q, F.lit(0.0), lambda s, x: s + F.when(F.exists(d, lambda y: F.abs(x - y) <= 0.01), 1.0).when(F.exists(d, lambda y: F.abs(x - y) <= 0.1 * F.abs(x)), 0.5).otherwise(0.0))
    return F.when(F.size(q) == 0, F.least(F.size(d) / 10, F.lit(1.0))).otherwise(F.least(score / F.size(q), F.lit(1.0)))


def code_level(code: str | Column) -> Column:
    """part, section, clause or item of a six-digit code by its trailing zeros."""
    c = _c(code)
    return F.when(~c.rlike(r"^[0-9]{6}$"), None).when(c.endswith("0000"), "part").when(c.endswith("000"), "section").when(c.endswith("00"), "clause").otherwise("item")


def display(value: str | Column) -> Column:
    """Thousands separators, no decimals for whole numbers, else two."""
    v = _c(value)
    return F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def estimate_seconds(size: str | Column, kind: str | Column, queue: str | Column) -> Column:
    """Expected processing time: a base by kind and megabytes, once more for each job ahead, doubled."""
    mb = _c(size) / 1048576
    base = F.when(_c(kind) == "pdf", 10 + 5 * mb).when(_c(kind) == "xlsx", 5 + 2 * mb).otherwise(2 + mb)
    return 2 * (base + _c(queue) * base)
