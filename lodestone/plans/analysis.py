"""Rules that turn a question into a plan: category, years, direction and number, dimensions; pure Python on the driver.

The order of the categories is part of their meaning: a question for a balance is tested for comparison first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
COMPARISON = ("compare", "versus", " vs ", "difference", "growth", "change", "مقایسه", "اختلاف", "تفاوت", "رشد", "نسبت به")
BALANCE = ("balance", "surplus", "deficit", "تراز", "مازاد", "کسری")
BREAKDOWN = ("by section", "breakdown", "per ", "each", "تفکیک", "به تفکیک", "هر ")
TOP = ("top", "largest", "highest", "most", "بیشترین", "بالاترین", "بزرگترین")
BOTTOM = ("smallest", "lowest", "least", "کمترین", "پایین‌ترین", "کوچکترین")
MONEY = ("budget", "income", "revenue", "cost", "expense", "total", "sum", "بودجه", "درآمد", "هزینه", "اعتبار", "مصارف", "منابع", "جمع")
GREETINGS = ("hello", "hi", "good morning", "سلام", "درود", "صبح بخیر")
DIMENSIONS = {"section": ("section", "بخش"), "clause": ("clause", "بند"), "item": ("item", "جزء"), "year": ("year", "سال")}
STOP = ("?", "؟", "!", ".", "،", ",")


@dataclass
class QueryPlan:
    text: str
    category: str
    years: list[int] = field(default_factory=list)
    largest: bool = True
    limit: int = 10
    dimensions: list[str] = field(default_factory=list)
    comparison: str | None = None
    confidence: float = 1.0


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def year_of(token: str) -> int | None:
    """A solar year from four, three or two digits."""
    n = int(token)
    if len(token) == 4:
        return n if 1300 <= n <= 1499 else None
    if len(token) == 3:
        return n + 1000 if 300 <= n <= 499 else None
    return (n + 1300 if n >= 50 else n + 1400) if len(token) == 2 else None


def years(text: str) -> list[int]:
    """Years named in a text and all years of named ranges."""
    t = text.translate(DIGITS)
    out = set()
    for a, b in re.findall(r"(?<!\d)(\d{2,4})\s*(?:-|تا|to)\s*(\d{2,4})(?!\d)", t):
        x, y = year_of(a), year_of(b)
        if x and y and x <= y:
            out.update(range(x, y + 1))
    out.update(y for y in map(year_of, re.findall(r"(?<!\d)\d{2,4}(?!\d)", t)) if y)
    return sorted(out)


def category(text: str) -> str:
    t = f" {text.lower()} "
    if not _has(t, MONEY + BALANCE + TOP + BOTTOM + COMPARISON):
        return "non_financial"
    if _has(t, COMPARISON):
        return "comparison"
    if _has(t, BALANCE):
        return "cross_table"
    if _has(t, BREAKDOWN):
        return "breakdown"
    return "top_n" if _has(t, TOP + BOTTOM) else "simple_sum"


def wanted_rows(text: str) -> int:
    """An explicit number up to 100, else 5 for a plural, 1 for a singular superlative, 10 otherwise."""
    t = text.translate(DIGITS).lower()
    if m := re.search(r"(?:top|first|largest|بیشترین|اول)\s+(\d{1,3})\b|\b(\d{1,3})\s+(?:largest|top|مورد)", t):
        return max(1, min(100, int(m[1] or m[2])))
    if not _has(t, TOP + BOTTOM):
        return 10
    return 5 if re.search(r"\b(?:which|what)\s+\w+s\b|ها", t) else 1


def comparison_kind(text: str, found: list[int], entities: int) -> str | None:
    t = text.lower()
    if _has(t, BALANCE):
        return "balance"
    if entities >= 2:
        return "entity"
    if len(found) == 2:
        return "year_over_year"
    return "trend" if len(found) > 2 or "trend" in t or "روند" in t else None


def analyse(text: str, entities: int = 0) -> QueryPlan:
    t, found = text.lower(), years(text)
    kind = category(text)
    dims = [k for k, words in DIMENSIONS.items() if _has(t, words)]
    words = len(t.split())
    confidence = (0.9 if entities == 1 else 1.0) * (0.7 if entities > 3 else 1.0) * (0.6 if words < 3 else 0.8 if words > 30 else 1.0)
    return QueryPlan(text, kind, found, not _has(t, BOTTOM), wanted_rows(text), dims, comparison_kind(text, found, entities) if kind == "comparison" else None, round(confidence, 6))


def is_greeting(text: str) -> bool:
    t = text.lower().strip("".join(STOP) + " ")
    return any(t == g or t.startswith(g + " ") and len(t.split()) <= 4 for g in GREETINGS)


def route(text: str, has_tables: bool) -> tuple[str, str | None, float]:
    """Primary path, fallback and confidence: tables for money questions if there are any, else documents."""
    if is_greeting(text):
        return "greeting", None, 1.0
    if has_tables and category(text) != "non_financial":
        return "database", "rag", 0.9
    return ("hybrid", "rag", 0.6) if has_tables else ("rag", None, 0.8)


def sub_questions(text: str, most: int = 4) -> list[str]:
    """Parts of a question between question marks and connectives; the whole text if none is long enough."""
    parts = [p.strip(" ،,") for p in re.split(r"[?؟]|\s+(?:and also|و همچنین|همچنین)\s+", text)]
    kept = [p for p in parts if len(p) > 5]
    if len(kept) <= 1:
        kept = [p.strip() for p in re.split(r"\s+(?:and|و)\s+", text.strip(" ?؟")) if len(p.strip()) > 5]
    return kept[:most] if len(kept) > 1 else [text.strip()]


def complexity(text: str) -> float:
    """A base by kind, raised by length, clauses and technical words; at most 1."""
    t = text.lower()
    base = 0.5 if category(text) in ("comparison", "cross_table") else 0.3
    clauses = len(re.findall(r"\b(?:and|or|but)\b|\sو\s|[,،;]", t))
    return min(1.0, base + 0.01 * len(t.split()) + 0.1 * clauses + (0.2 if re.search(r"\b(?:ratio|average|percent|rate)\b|درصد|نسبت|میانگین", t) else 0.0))


def default_year(text: str, year: int = 1403) -> str:
    """The text with a default year where it names none."""
    return text if years(text) else f"{text.rstrip(' ?؟')} {year}"


def compared_entities(text: str) -> tuple[str, str] | None:
    """The two sides of a comparison."""
    for pattern in (r"(?i)(?:compare|difference between|مقایسه)\s+(.+?)\s+(?:and|with|to|و|با)\s+(.+?)\s*[?؟.]*$", r"(?i)(.+?)\s+(?:versus|vs\.?|در مقابل)\s+(.+?)\s*[?؟.]*$"):
        if m := re.search(pattern, text.strip()):
            return m[1].strip(), m[2].strip()
    return None
