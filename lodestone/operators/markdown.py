"""Stored pages as Markdown: headings, nested lists, quotes, tables, code, emphasis and absolute links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: elements left out with all they hold
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form")
#: fixed values: links that stay plain text begin so
PLAIN_LINKS = ("#", "javascript:", "mailto:")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: an end tag of an inline element does not reach beyond these
_SCOPES = frozenset("blockquote caption dd dt li ol table td th ul".split())
_STYLES = {"b": 0, "strong": 0, "i": 1, "em": 1, "code": 2, "kbd": 2, "samp": 2, "tt": 2}
#: a start tag closes an open element of these, unless one of the second kind lies between
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SPECIAL = re.compile(r"([\\`*_\[\]<>|])")
_LINE_START = re.compile(r"^(?:([#+\-=~])|([0-9]+)([.)]))")
#: quotes and list items nested deeper are drawn at this depth, so that prefixes do not grow with the square of a page
DEEPEST = 32
#: a cell that spans columns is followed by at most so many empty ones
WIDEST = 20


class OpenElements(HTMLParser):
    """The stack of open elements, in which end tags that are left out are implied; each event costs what it opens or closes."""

    def __init__(self, dropped: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.open: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each name, where it stands in `open`
        self.scopes: list[int] = []

    def enter(self, tag: str, named: dict) -> None:
        """After an element, with its attributes, was opened; void ones are not left."""

    def leave(self, tag: str) -> None:
        """After an element was closed."""

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(tag)

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop()
            self.places[tag].pop()
            if tag in _SCOPES:
                self.scopes.pop()
            self.leave(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag in _CLOSES:
            same, walls = _CLOSES[tag]
            place = max(self.last(t) for t in same)
            if place > max(self.last(t) for t in walls):
                self.pop_to(place)
        elif tag in _BLOCKS and self.last("p") > max(self.scopes[-1] if self.scopes else -1, -1):
            self.pop_to(self.last("p"))
        elif tag == "a" and self.last("a") > (self.scopes[-1] if self.scopes else -1):
            self.pop_to(self.last("a"))
        if tag not in VOID:
            self.push(tag)
        self.enter(tag, named)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, the slash says nothing

    def handle_endtag(self, tag: str) -> None:
        place = self.last(tag)
        wall = -1
        if tag in self.dropped:
            wall = -1  # what is left open inside of it does not keep it open
        elif tag not in _BLOCKS:
            wall = self.scopes[-1] if self.scopes else -1
        elif tag != "table":
            wall = self.last("table")
        if place >= 0 and place >= wall:
            self.pop_to(place)

class _Writer(OpenElements):
    """Parser events to blocks of Markdown; a page takes linear time."""

    def __init__(self, url: str, dropped: frozenset[str]) -> None:
        super().__init__(dropped)
        self.base = url
        self.gone = 0  # open elements that are left out
        self.blocks: list[str] = []
        self.runs: list[tuple[str, tuple[bool, bool, bool], str | None]] = []
        self.styles = [0, 0, 0]
        self.hrefs: list[str | None] = []
        self.nest: list[list] = []  # quotes and list items: [first prefix, further prefix, used]
        self.lists: list[int | None] = []  # the next number, or None without numbers
        self.rows: list[list[list[str]]] | None = None  # rows of cells of parts
        self.head = False  # the first row is one of headers
        self.cells = 0
        self.span = 1
        self.tight = False  # the last block stood in a list
        self.around: list[list] = []  # and in these
        self.code: list[str] | None = None
        self.language = ""
        self.title, self.description, self.in_title, self.n_links = "", "", False, 0

    def enter(self, tag: str, named: dict) -> None:
        if tag in self.dropped:
            self.gone += 1
            self.flush()
        if self.gone:
            return
        if tag == "title":
            self.in_title = not self.title
        elif tag == "meta" and (named.get("name") or "").lower() == "description":
            self.description = self.description or (named.get("content") or "").strip()
        elif tag == "base" and named.get("href"):
            self.base = _absolute(self.base, named["href"]) or self.base
        if self.code is not None:
            if tag == "code":
                self.language = self.language or _language(named)
            if tag == "br":
                self.code.append("\n")
            return
        if tag in _BLOCKS:
            self.flush()
        if tag in _STYLES:
            self.styles[_STYLES[tag]] += 1
        elif tag == "br":
            self.runs.append(("\n", (False, False, False), None))
        elif tag == "hr":
            self.put("---")
        elif tag == "a":
            self.hrefs.append(self.target(named.get("href")))
        elif tag == "pre" and self.rows is None:
            self.code, self.language = [], _language(named)
        elif tag == "table":
            self.cells += 1
            if self.cells == 1:
                self.rows, self.head = [], False
        elif tag == "blockquote":
            self.nest.append(["> ", "> ", False])
        elif tag in ("ul", "ol", "menu", "dir"):
            start = named.get("start") or "1"
            self.lists.append((int(start) if re.fullmatch(r"[0-9]{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
            self.nest.append([mark, " " * len(mark), False])
        elif tag == "tr" and self.cells == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.cells == 1:
            if not self.rows:
                self.rows.append([])
            self.head = self.head or (tag == "th" and len(self.rows) == 1)
            span = named.get("colspan") or "1"
            self.rows[-1].append([])
            self.span = min(int(span) if re.fullmatch(r"[0-9]{1,4}", span) else 1, WIDEST)
        elif tag == "thead" and self.cells == 1:
            self.head = self.head or not self.rows

    def leave(self, tag: str) -> None:
        if tag in self.dropped:
            self.gone -= 1
            return
        if self.gone:
            return
        if tag == "title":
            self.in_title = False
        if self.code is not None:
            if tag == "pre":
                self.end_code()
            return
        if tag in _BLOCKS:
            self.flush("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "", tag == "caption" and self.cells == 1 and not self.rows)
        if tag in _STYLES:
            self.styles[_STYLES[tag]] -= 1
        elif tag == "a" and self.hrefs:
            self.hrefs.pop()
        elif tag in ("blockquote", "li") and self.nest:
            if tag == "li" and not self.nest[-1][2] and len(self.nest) <= DEEPEST and self.rows is None:
                self.put("")
            self.nest.pop()
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in ("td", "th") and self.cells == 1:
            self.rows[-1] += [[] for _ in range(self.span - 1)]
            self.span = 1
        elif tag == "table":
            self.cells -= 1
            if self.cells == 0:
                self.end_table()

    def handle_data(self, data: str) -> None:
        if self.gone:
            return
        if self.in_title:
            self.title += data
        elif self.code is not None:
            self.code.append(data)
        else:
            self.runs.append((data, (self.styles[0] > 0, self.styles[1] > 0, self.styles[2] > 0), self.hrefs[-1] if self.hrefs else None))

    # blocks

    def target(self, href: str | None) -> str | None:
        href = (href or "").strip()
        if not href or href.lower().startswith(PLAIN_LINKS):
            return None
        return _absolute(self.base, href)

    def flush(self, mark: str = "", above: bool = False) -> None:
        """The collected text as one block, or, unless it goes above it, as part of a table's open cell."""
        if not self.runs:
            return
        runs, self.runs = self.runs, []
        text, links = _inline(runs, one_line=bool(mark) or self.rows is not None)
        self.n_links += links
        if not text:
            return
        if self.rows is not None and not above:
            if not self.rows:
                self.rows.append([])
            if not self.rows[-1]:
                self.rows[-1].append([])  # text outside of cells stands in one of its own
            self.rows[-1][-1].append(text)
            return
        self.put(mark + text)

    def put(self, text: str) -> None:
        """A block with the prefixes of the quotes and items that it stands in; lines of one list follow each other closely."""
        nest = self.nest[:DEEPEST]
        first = "".join(n[1] if n[2] else n[0] for n in nest)
        rest = "".join(n[1] for n in nest)
        opens = any(not n[2] and n[0] != n[1] for n in nest)
        shared = 0
        while shared < min(len(nest), len(self.around)) and nest[shared] is self.around[shared]:
            shared += 1
        gap = "\n" if self.tight and opens else "\n" + "".join(n[1] for n in nest[:shared]).rstrip() + "\n"
        for n in nest:
            n[2] = True
        lines = text.split("\n")
        body = "\n".join([(first + lines[0]).rstrip(), *((rest + line).rstrip() for line in lines[1:])])
        self.blocks.append(gap + body if self.blocks else body)
        self.tight, self.around = bool(self.lists), nest

    def end_code(self) -> None:
        text, self.code = "".join(self.code), None
        text = text[1:] if text.startswith("\n") else text
        if text.strip():
            ticks = max((len(t) for t in re.findall("`+", text)), default=0)
            fence = "`" * max(3, ticks + 1)
            self.put(f"{fence}{self.language}\n{text.rstrip()}\n{fence}")

    def end_table(self) -> None:
        rows, self.rows = self.rows, None
        rows = [[" ".join(cell) for cell in row] for row in rows]
        rows = [row for row in rows if any(row)]
        if not rows:
            return
        width = max(map(len, rows))
        if not self.head:
            rows.insert(0, [])
        rows[0] += [""] * (width - len(rows[0]))
        lines = ["| " + " | ".join(row) + " |" for row in rows]
        self.put("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))

    def finish(self) -> None:
        self.close()
        self.pop_to(0)
        self.flush()
        if self.rows is not None:
            self.end_table()


def _language(named: dict) -> str:
    found = re.search(r"(?:language|lang)-([A-Za-z0-9+#-]+)", named.get("class") or "")
    return found.group(1) if found else ""


def _absolute(base: str, href: str) -> str | None:
    try:
        found = urljoin(base, href)
    except ValueError:
        return None
    return re.sub(r"[\s()<>]", lambda m: f"%{ord(m.group()):02X}" if ord(m.group()) < 128 else "%20", found)


def _styled(text: str, style: tuple[bool, bool, bool]) -> str:
    bold, italic, code = style
    body = text.strip(" ")
    if not body or not any(style):
        return _SPECIAL.sub(r"\\\1", text)
    lead, tail = text[: len(text) - len(text.lstrip(" "))], text[len(text.rstrip(" ")) :]
    if code and "`" not in body and "|" not in body:
        out = f"`{body}`"
    else:
        out = _SPECIAL.sub(r"\\\1", body)
    mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
    return lead + mark + out + mark + tail


def _inline(runs: list, one_line: bool) -> tuple[str, int]:
    """Runs of text with styles and links as one line, or as lines where breaks were; and the number of links."""
    pieces: list[list] = []
    blank = True  # nothing, a blank or a break stands before
    for text, style, href in runs:
        if text == "\n" and href is None and not any(style) and not one_line:
            # a break, or white space that holds nothing else
            text = "\n"
        else:
            text = _SPACE.sub(" ", text)
            if blank and text.startswith(" "):
                text = text[1:]
        if not text:
            continue
        blank = text.endswith((" ", "\n"))
        if pieces and pieces[-1][1] == style and pieces[-1][2] == href:
            pieces[-1][0].append(text)
        else:
            pieces.append([[text], style, href])
    out, links, k = [], 0, 0
    while k < len(pieces):
        href, part = pieces[k][2], []
        while k < len(pieces) and pieces[k][2] == href:
            part.append(_styled("".join(pieces[k][0]), pieces[k][1]))
            k += 1
        text = "".join(part)
        if href is not None and text.strip():
            body = text.strip()
            out.append(text[: len(text) - len(text.lstrip())] + f"[{body}]({href})" + text[len(text.rstrip()) :])
            links += 1
        else:
            out.append(text)
    lines = [line.strip() for line in "".join(out).split("\n")]
    lines = [_LINE_START.sub(lambda m: "\\" + m.group() if m.group(1) else f"{m.group(2)}\\{m.group(3)}", line) for line in lines if line]
    return "\\\n".join(lines), links


def html_to_markdown(html: str | None, url: str | None = None, dropped: Sequence[str] = DROPPED, least: int = 50) -> tuple[str, str, str, int]:
    """Markdown, title, description and the number of links of a page.

    No text outside the dropped elements and the title is lost, whatever is left open or closed twice; comments are no text. The
    Markdown of a page is empty unless it has more than `least` characters. Null is an empty page.
    """
    w = _Writer(url or "", frozenset(dropped))
    w.feed(html or "")
    w.finish()
    text = "".join(w.blocks)
    full = len(text) > least
    return (text if full else ""), _SPACE.sub(" ", w.title).strip(), _SPACE.sub(" ", w.description).strip(), (w.n_links if full else 0)


def page_markdown(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", dropped: Sequence[str] = DROPPED, least: int = 50) -> DataFrame:
    """page_id, url, title, description, markdown and n_links of each page, repeated ones too; one pass, nothing is shuffled."""
    names = ["page_id", "url", "title", "description", "markdown", "n_links"]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64()]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = [html_to_markdown(h, u, dropped, least) for h, u in zip(part.column(2).to_pylist(), urls, strict=True)]
                cols = [ids, urls, [m[1] for m in made], [m[2] for m in made], [m[0] for m in made], [m[3] for m in made]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, title string, description string, markdown string, n_links long")
