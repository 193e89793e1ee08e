"""Text of PDF files by pages, from the file format itself; a better parser can be given to the reader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
STREAM = re.compile(rb"\bstream\r?\n")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|[\[\]]|[-+]?[0-9.]+|[A-Za-z'\"][A-Za-z0-9*]*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
GAP = -200  # thousandths of a letter's height that part two words


def _inflate(body: bytes, stream: bytes) -> bytes:
    if b"/FlateDecode" not in body:
        return b"" if b"/Filter" in body else stream
    try:
        return zlib.decompressobj().decompress(stream)
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Dictionary and plain stream of every object, those inside object streams included."""
    out, at = {}, 0
    while head := OBJECT.search(data, at):
        end = data.find(b"endobj", head.end())
        if end < 0:
            break
        opened, close = STREAM.search(data, head.end(), end), -1
        if opened:
            close = data.find(b"endstream", opened.end())
            end = max(end, data.find(b"endobj", close)) if close >= 0 else end
        body = data[head.end() : opened.start() if opened else end]
        out[int(head[1])] = (body, _inflate(body, data[opened.end() : close]) if opened and close >= 0 else b"")
        at = end
    for body, stream in [*out.values()]:
        first = re.search(rb"/First\s+(\d+)", body)
        if b"/ObjStm" in body and first:
            start = int(first[1])
            heads = [int(x) for x in stream[:start].split()]
            places = list(zip(heads[::2], heads[1::2], strict=False))
            for k, (number, at) in enumerate(places):
                end = start + places[k + 1][1] if k + 1 < len(places) else len(stream)
                out.setdefault(number, (stream[start + at : end], b""))
    return out


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, tuple[bytes, bytes]]) -> list[int]:
    """Page objects in reading order: down the page tree, and any that it lacks after that."""
    is_page = lambda n: re.search(rb"/Type\s*/Page\b(?!s)", objects[n][0])
    roots = [n for n, (b, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    found, seen, todo = [], set(), roots[::-1]
    while todo:
        n = todo.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if is_page(n):
            found.append(n)
        todo += _refs(objects[n][0], b"Kids")[::-1]
    return found + [n for n in sorted(objects) if n not in seen and is_page(n)]


def _letters(stream: bytes) -> dict[int, str]:
    """Code to text of a font's own map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", part):
            low, high = int(a, 16), min(int(b, 16), 0xFFFF)
            out |= {c: text(to)[:-1] + chr(min(ord(text(to)[-1]) + c - low, 0x10FFFF)) for c in range(low, high + 1)}
    return out


def _fonts(objects: dict[int, tuple[bytes, bytes]], page: int) -> dict[bytes, dict[int, str]]:
    """The maps of a page's fonts by name; resources are looked for up the page tree."""
    seen: set[int] = set()
    while page in objects and page not in seen:
        seen.add(page)
        body = objects[page][0]
        own = body + b"".join(objects[n][0] for n in _refs(body, b"Resources") if n in objects)
        own += b"".join(objects[n][0] for n in _refs(own, b"Font") if n in objects)
        names = {name: objects[int(n)][0] for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", own) if int(n) in objects and re.search(rb"/Type\s*/Font\b", objects[int(n)][0])}
        if names:
            return {name: _letters(b"".join(objects[n][1] for n in _refs(b, b"ToUnicode") if n in objects)) for name, b in names.items()}
        page = next(iter(_refs(body, b"Parent")), -1)
    return {}


def _string(token: bytes, letters: dict[int, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"[<>\s]", b"", token).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if not letters:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = 2 if max(letters) > 255 or (token[:1] == b"<" and len(raw) % 2 == 0 and raw[:1] == b"\0") else 1
    return "".join(letters.get(int.from_bytes(raw[k : k + width]), "") for k in range(0, len(raw), width))


def _shown(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """What a page's content shows, a line for each move to another height."""
    out: list[str] = []
    stack: list[bytes] = []
    letters: dict[int, str] = {}
    height = None
    for m in TOKEN.finditer(content):
        t = m[0]
        if not (t[:1].isalpha() or t in (b"'", b'"')):
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) > 1:
            letters = fonts.get(stack[-2][1:], {})
        elif t in (b"T*", b"ET"):
            out.append("\n")
        elif t in (b"Td", b"TD") and stack:
            out.append("\n" if float(stack[-1].strip(b".") or 0) else " ")
        elif t == b"Tm" and stack:
            out.append(" " if stack[-1] == height else "\n")
            height = stack[-1]
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out.append("\n" if t in (b"'", b'"') else "")
            parts = stack if t == b"TJ" else stack[-1:]
            for p in parts:
                if p[:1] in (b"(", b"<"):
                    out.append(_string(p, letters))
                elif p[:1] in b"-" and float(p) < GAP:
                    out.append(" ")
        stack = []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_pages(data: bytes) -> list[str]:
    """The text of every page; none if it isn't a PDF file, blank for a page of images or of a filter other than deflate."""
    if b"%PDF" not in data[:1024]:
        return []
    objects, out = _objects(data), []
    for page in _pages(objects):
        content = b"\n".join(objects[n][1] for n in _refs(objects[page][0], b"Contents") if n in objects)
        try:
            out.append(_shown(content, _fonts(objects, page)))
        except ValueError:  # a malformed number or string
            out.append("")
    return out


def read_pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """path, page (from 0) and text of PDF files by a parser that runs on the executors; a broken file has no row."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pages = parse(data.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.string())], ["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page int, text string")
