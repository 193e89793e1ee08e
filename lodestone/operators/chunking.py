"""Chunkers as table functions over batches: every chunker ends, covers its text, and yields (chunk_index, start, chunk)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import whole_word

Piece = tuple[int, str]
BREAKS = ("\n\n", "\n", ". ", "؟ ", "! ", " ")
SENTENCE = re.compile(r"[^.!?؟\n]*[.!?؟]+\s*|[^.!?؟\n]+(?:\n+|$)|\n+")


def windows(text: str, size: int = 1000, overlap: int = 200) -> Iterator[Piece]:
    """Windows of at most `size` characters that end at a break in their second half if there is one; each starts after the last."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for mark in BREAKS:
                at = text.rfind(mark, start + size // 2, end)
                if at > 0:
                    end = at + len(mark)
                    break
        yield start, text[start:end]
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def packed(pieces: list[str], size: int, joiner: str = "") -> Iterator[Piece]:
    """Greedy packing of pieces; one that is longer than the size stands alone."""
    held, at, start = "", 0, 0
    for p in pieces:
        if held and len(held) + len(joiner) + len(p) > size:
            yield start, held
            held, start = "", at
        held = held + joiner + p if held else p
        at += len(p)
    if held:
        yield start, held


def word_chunks(text: str, size: int = 500) -> Iterator[Piece]:
    return packed(text.split(), size, " ")


def sentences(text: str) -> list[str]:
    """Pieces that end at a sentence mark or line end; together they are the text."""
    return SENTENCE.findall(text) if text else []


def sentence_chunks(text: str, size: int = 600, overlap: int = 80, least: int = 50) -> Iterator[Piece]:
    """Sentences packed to the size, starting with the sentences before it that fit the overlap; short chunks are dropped unless alone."""
    found = [s for s in sentences(text) if s.strip()]
    out, held, start, at = [], [], 0, 0
    for s in found:
        if held and sum(map(len, held)) + len(s) > size:
            out.append((start, "".join(held)))
            tail: list[str] = []
            while held and sum(map(len, tail)) + len(held[-1]) < overlap:
                tail.insert(0, held.pop())
            held, start = tail, at - sum(map(len, tail))
        held.append(s)
        at += len(s)
    if held:
        out.append((start, "".join(held)))
    yield from [c for c in out if len(c[1].strip()) >= least] or out[:1]


def paragraph_chunks(text: str, size: int = 1000, overlap: int = 100) -> Iterator[Piece]:
    tail = ""
    for start, chunk in packed([p for p in re.split(r"(?<=\n)\n+", text) if p.strip()], size):
        yield start, tail + chunk
        tail = chunk[-overlap:] if overlap else ""


def article_chunks(text: str, size: int = 1500, overlap: int = 300, header: str = r"(?m)^(?=(?:ماده|Article|Artikel|Artículo)\s+\d+)", least: int = 20) -> Iterator[Piece]:
    """One chunk per article where there are three headers or more, long ones in windows; else windows."""
    parts = re.split(header, text)
    if len(parts) < 4:
        yield from windows(text, size, overlap)
        return
    at = 0
    for p in parts:
        if len(p.strip()) >= least:
            if len(p) > 2 * size:
                yield from ((at + s, c) for s, c in windows(p, size, overlap))
            else:
                yield at, p
        at += len(p)


def fenced_chunks(text: str, size: int = 800) -> Iterator[Piece]:
    """Code blocks stay whole."""
    parts = [p for p in re.split(r"(```.*?```)", text, flags=re.S) if p.strip()]
    return packed(parts, size)


def section_chunks(text: str, size: int = 1200) -> Iterator[Piece]:
    """Tables and sections in document order, packed."""
    return packed([p for p in re.split(r"(?m)^(?=\|)|(?<=\|)\n(?!\|)|^(?=#{1,3} )", text) if p and p.strip()], size)


CHUNKERS: dict[str, Callable[..., Iterator[Piece]]] = {
    "window": windows, "word": word_chunks, "sentence": sentence_chunks, "paragraph": paragraph_chunks, "article": article_chunks, "fenced": fenced_chunks, "section": section_chunks,
}


def chunk(docs: DataFrame, doc_id: str | None, text: str, kind: str = "window", carry: Sequence[str] = (), totals: bool = False, **options: int) -> DataFrame:
    """doc_id, chunk_index, start and chunk of every text; a null or blank text has none.

    Columns to carry stand before them on every chunk; without doc_id there is none; with totals, n_chunks of the text follows.
    """
    run_one = CHUNKERS[kind]
    keep = [*carry, *([] if doc_id is None else ["doc_id"])]
    given = docs.select(*carry, *([] if doc_id is None else [F.col(doc_id).cast("long").alias("doc_id")]), F.col(text).cast("string").alias("__text"))
    own = [("chunk_index", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("chunk", T.StringType(), pa.string()), ("n_chunks", T.IntegerType(), pa.int32())][: 4 if totals else 3]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                places, rows = [], []
                for i, t in enumerate(part.column(len(keep)).to_pylist()):
                    pieces = list(run_one(t, **options)) if t and t.strip() else []
                    places += [i] * len(pieces)
                    rows += [(k, start, piece, len(pieces))[: len(own)] for k, (start, piece) in enumerate(pieces)]
                columns = list(zip(*rows, strict=True)) or [()] * len(own)
                kept = [part.column(k).take(pa.array(places, pa.int64())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, (_, _, t) in zip(columns, own, strict=True)], [*keep, *(n for n, _, _ in own)])

    schema = T.StructType([*given.schema.fields[: len(keep)], *(T.StructField(n, t) for n, t, _ in own)])
    return given.mapInArrow(run, schema)


def content_type(text: str | Column) -> Column:
    """legal, financial, technical, conversational or general by the first pattern that occurs."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.when(t.rlike(r"(ماده|تبصره)\s+\d+|(?i)(?<![0-9A-Za-z_])article\s+\d+"), "legal").when(t.rlike(rf"(?m)^\|.*\|\s*$|(?i){whole_word('budget|revenue')}|بودجه|درآمد"), "financial")
        .when(t.rlike(rf"```|(?i){whole_word('function|class|api')}"), "technical").when(t.rlike(r"[?؟]"), "conversational").otherwise("general")
    )


def chunk_traits(text: str | Column) -> list[Column]:
    """Counts and flags of a chunk."""
    t = F.col(text) if isinstance(text, str) else text
    return [
        F.length(t).alias("n_chars"), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).alias("n_words"), F.size(F.split(t, "\n")).alias("n_lines"),
        F.regexp_count(t, F.lit(r"[0-9]+")).alias("n_numbers"), t.rlike(r"[0-9]").alias("has_numbers"), t.rlike(r"(?m)^\s*[-*•] ").alias("has_list"),
        t.contains("|").alias("has_table"), t.rlike(r"[?؟]").alias("has_question"), t.contains("```").alias("has_code"), t.rlike(r"https?://").alias("has_url"),
    ]


def marked_rows(df: DataFrame, doc_id: str, text: str, marker: str = r"(?=Page \d+, Table \d+, Row \d+)") -> DataFrame:
    """One row per marker in a combined chunk."""
    parts = F.filter(F.split(F.col(text), marker), lambda p: F.trim(p) != "")
    return df.select(doc_id, F.posexplode(parts).alias("part", "chunk"))
