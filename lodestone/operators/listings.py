"""Items of stored pages: what a page declares, records mined from its repeated subtrees, and prices with the heading above."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.markdown import PLAIN_LINKS, VOID, OpenElements
from lodestone.operators.web import page_items

#: what stands in one of these is a menu
MENUS = frozenset({"nav", "header", "footer", "aside", "form"})
#: siblings are alike if twice the tag paths that both have are so large a part of all of both
ALIKE = 0.6
#: tag paths reach so deep below a sibling
DEPTH = 4
#: fixed values: currencies of prices
CURRENCIES = ("تومان", "ریال", "$", "€", "£", "¥", "USD", "EUR", "GBP")

_SILENT = frozenset({"script", "style", "template", "title"})
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_KINDS = {"tr": "table", "li": "list", "dt": "list"}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_MONEY = "|".join(re.escape(c) for c in CURRENCIES)
# a number is taken whole or not at all, so that long ones do not cost the square of their length
_PRICE = re.compile(rf"(?:{_MONEY})\s?[0-9][0-9,.٬]*+|(?<![0-9,.٬])[0-9][0-9,.٬]*+\s?(?:{_MONEY})")

Item = tuple[str, str, str, str, float]


class _Node:
    """An element; sizes count characters without white space, shape[d] are the tag paths of d steps."""

    __slots__ = ("covered", "heads", "href", "inner", "linked", "menu", "priced", "regions", "shape", "size", "tag")

    def __init__(self, tag: str, href: str | None, menu: bool) -> None:
        self.tag, self.href, self.menu = tag, href, menu
        self.inner: list[_Node | str] = []
        self.size = self.linked = self.covered = 0
        self.heads = self.priced = False
        self.shape: list[set[str]] | None = None
        self.regions: list = []  # of regions, and of such lists of elements below


class _Tree(OpenElements):
    """Parser events to elements, in the order in which they close."""

    def __init__(self, url: str) -> None:
        super().__init__(frozenset())
        self.base = url
        self.root = _Node("", None, False)
        self.stack, self.closed, self.silent = [self.root], [], 0

    def enter(self, tag: str, named: dict) -> None:
        if tag == "base" and named.get("href"):
            self.base = _joined(self.base, named["href"]) or self.base
        node = _Node(tag, named.get("href") if tag == "a" else None, self.stack[-1].menu or tag in MENUS)
        self.stack[-1].inner.append(node)
        if tag in VOID:
            self.closed.append(node)
        else:
            self.stack.append(node)
            self.silent += tag in _SILENT

    def leave(self, tag: str) -> None:
        self.silent -= tag in _SILENT
        self.closed.append(self.stack.pop())

    def handle_data(self, data: str) -> None:
        if not self.silent and data.strip():
            self.stack[-1].inner.append(data)


def _joined(base: str, link: str) -> str:
    link = link.strip()
    try:
        found = urljoin(base, link)
    except ValueError:
        return ""
    # urljoin drops the mark of an empty query, fragment or parameter
    return found + link[-1] if link[-1:] in ("?", "#", ";") and not found.endswith(link[-1]) else found


def _measure(node: _Node, least: int) -> None:
    """Sizes, tag paths and regions of an element whose children are measured."""
    node.shape = [{node.tag}, *(set() for _ in range(DEPTH))]
    kids = []
    for x in node.inner:
        if isinstance(x, str):
            node.size += sum(map(len, x.split()))
            node.priced = node.priced or _PRICE.search(x) is not None
            node.shape[1].add(node.tag + "/#")
            continue
        kids.append(x)
        node.size += x.size
        node.linked += x.linked
        node.heads = node.heads or x.heads
        node.priced = node.priced or x.priced
        for d in range(DEPTH):
            node.shape[d + 1].update(f"{node.tag}/{p}" for p in x.shape[d])
    if node.tag == "a" and node.href:
        node.linked = node.size
    node.heads = node.heads or (node.tag in _HEADINGS and node.size > 0)
    found, within = _regions(kids, least), set()
    for region in found:
        within.update(id(x) for record in region for x in record)
        node.covered += sum(x.size for record in region for x in record)
    node.regions = [*found, *(x.regions for x in kids if x.regions and id(x) not in within)]
    node.covered += sum(x.covered for x in kids if id(x) not in within)
    for x in kids:
        x.shape = None


def _alike(a: _Node, b: _Node) -> bool:
    both = sum(len(p & q) for p, q in zip(a.shape, b.shape, strict=True))
    return 2 * both >= ALIKE * sum(len(p) + len(q) for p, q in zip(a.shape, b.shape, strict=True))


def _regions(kids: list[_Node], least: int) -> list[tuple[tuple[_Node, ...], ...]]:
    """The repeated records among siblings, each one or several elements.

    A sibling joins the chain of the last one of its tag, or else the longest chain of its tag, if it is like that one's last
    member: two comparisons a sibling. A chain of `least` members and more starts records. A record takes in the siblings of
    other tags up to the next one whose chains recur at least half as often, as terms take in their definitions.
    """
    last: dict[str, list[int]] = {}
    longest: dict[str, list[int]] = {}
    chains, chain_of = [], {}
    for k, x in enumerate(kids):
        if not x.size:
            continue
        mine = None
        for known in (last.get(x.tag), longest.get(x.tag)):
            if known is not None and _alike(kids[known[-1]], x):
                mine = known
                break
        if mine is None:
            mine = []
            chains.append(mine)
        mine.append(k)
        chain_of[k] = mine
        last[x.tag] = mine
        if len(mine) >= len(longest.get(x.tag, ())):
            longest[x.tag] = mine
    out, used = [], set()
    if not any(len(c) >= least for c in chains) or not any(x.linked or x.priced or x.heads for x in kids):
        return out
    for chain in chains:
        if len(chain) < least or used.intersection(chain):
            continue
        tag, records, widest = kids[chain[0]].tag, [], 1
        for k, nxt in zip(chain, [*chain[1:], None], strict=True):
            # the last record is no wider than the widest before it
            end = nxt if nxt is not None else min(len(kids), k + widest)
            follow = [j for j in range(k + 1, end) if j in chain_of and j not in used and kids[j].tag != tag and 2 * len(chain_of[j]) >= len(chain)]
            widest = max(widest, end - k if follow else 1)
            records.append([k, *follow])
        rows = tuple(tuple(kids[j] for j in r) for r in records)
        if 2 * sum(map(_anchored, rows)) >= len(rows) and 2 * sum(map(_wrapper, rows)) < len(rows):
            out.append(rows)
            used.update(j for r in records for j in r)
    return out


def _anchored(record: tuple[_Node, ...]) -> bool:
    """Whether something marks it as an item: a price, a heading within, or a link (in paragraphs: one that is most of the text)."""
    first = record[0]
    if any(x.priced for x in record):
        return True
    if first.tag == "p":
        return 2 * first.linked >= first.size > 0
    return any(x.linked for x in record) or (first.heads and first.tag not in _HEADINGS)


def _wrapper(record: tuple[_Node, ...]) -> bool:
    """Whether all its text lies in records within, as in a row of cards."""
    return all(x.covered == x.size for x in record)


def _pieces(record: tuple[_Node, ...], cell: _Node | None = None):
    """Texts of a record with the outermost heading (the given cell counts as one) and link that they stand in."""
    todo = [(x, None, None) for x in reversed(record)]
    while todo:
        x, head, link = todo.pop()
        if isinstance(x, str):
            yield _SPACE.sub(" ", x).strip(), head, link
            continue
        head = head or (x if x.tag in _HEADINGS or x.tag == "dt" or x is cell else None)
        link = link or (x if x.href is not None else None)
        todo += [(y, head, link) for y in reversed(x.inner)]


def _item(record: tuple[_Node, ...], base: str) -> tuple[str, str, str, str]:
    """title (the first heading or, in a row, cell with a letter, else the first link, else the first text), price, link, other text."""
    cells = [x for x in record[0].inner if isinstance(x, _Node) and x.tag in ("td", "th")] if record[0].tag == "tr" else []
    cell = next((x for x in cells if any(c.isalpha() for p, _, _ in _pieces((x,)) for c in p)), None)
    pieces = list(_pieces(record, cell))
    head = next((h for _, h, _ in pieces if h is not None), None)
    link = next((a for _, _, a in pieces if a is not None), None)
    titles = [k for k, (_, h, a) in enumerate(pieces) if (h is head if head is not None else a is link if link is not None else k == 0)]
    title = " ".join(pieces[k][0] for k in titles)
    # a number and its currency may stand in two elements
    price = next((m.group() for p, _, _ in pieces if (m := _PRICE.search(p))), None) or next((m.group() for m in [_PRICE.search(" ".join(p for p, _, _ in pieces))] if m), "")
    rest = " ".join(p for k, (p, _, _) in enumerate(pieces) if k not in set(titles) and p != price) if len(titles) < len(pieces) else ""
    # a link of the title comes first
    hrefs = [a.href.strip() for k, (_, _, a) in enumerate(pieces) if a is not None and k in set(titles)] + [a.href.strip() for _, _, a in pieces if a is not None]
    href = next((h for h in hrefs if h and not h.lower().startswith(PLAIN_LINKS)), None)
    return title, price, _joined(base, href) if href else "", rest


def _parsed(html: str, url: str, least: int) -> tuple[_Tree, list[tuple[tuple[_Node, ...], ...]]]:
    tree = _Tree(url)
    tree.feed(html)
    tree.close()
    tree.pop_to(0)
    for node in [*tree.closed, tree.root]:
        _measure(node, least)
    found, todo = [], [tree.root.regions]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        else:
            found.append(x)
    return tree, found


def repeated_items(html: str | None, url: str | None = None, least: int = 3) -> list[tuple[int, int, str, str, str, str, str, float]]:
    """Records of the repeated subtrees of a page: region, position, kind, title, price, link, description and confidence.

    Of regions within each other the outer one counts, unless its records only wrap inner ones. Kinds are menu (in a nav, header,
    footer, aside or form), table, list and cards. The confidence is 0.2 in menus; else 0.5, 0.4 or 0.3 where at least half of the
    records have a price, a link, or neither. Nothing is capped; a page takes time in proportion to its length. Null is an empty page.
    """
    tree, found = _parsed(html or "", url or "", least)
    out = []
    for number, region in enumerate(found):
        first = region[0][0]
        rows = [_item(record, tree.base) for record in region]
        sure = 0.5 if 2 * sum(r[1] != "" for r in rows) >= len(rows) else 0.4 if 2 * sum(r[2] != "" for r in rows) >= len(rows) else 0.3
        kind = "menu" if first.menu else _KINDS.get(first.tag, "cards")
        out += [(number, k, kind, *r, 0.2 if kind == "menu" else sure) for k, r in enumerate(rows)]
    return out


def _priced_items(tree: _Tree, found: list) -> list[Item]:
    """Prices outside of regions and menus, with the last heading before them."""
    taken = {id(x) for region in found for record in region for x in record}
    out, title, link = [], [], ""
    todo: list[tuple[_Node | str, bool]] = [(tree.root, False)]
    while todo:
        x, in_head = todo.pop()
        if isinstance(x, str):
            price = _PRICE.search(x)
            if in_head:
                title.append(_SPACE.sub(" ", x).strip())
            elif price and title:
                out.append((" ".join(title), price.group(), link, "", 0.4))
        elif id(x) not in taken and not x.menu:
            if x.tag in _HEADINGS:
                title, link = [], ""
            if x.href and in_head and not x.href.strip().lower().startswith(PLAIN_LINKS):
                link = link or _joined(tree.base, x.href)
            todo += [(y, in_head or x.tag in _HEADINGS) for y in reversed(x.inner)]
    return out


def layered_items(html: str | None, url: str | None = None, most: int | None = None, first_layer: bool = False) -> list[Item]:
    """title, price, link, description and confidence of all layers: declared items, repeated subtrees but menus, prices.

    A later layer adds titles, compared in lower case, that no earlier item has; with `first_layer` only the first layer that has
    items counts. Declared items, which share one layer of 0.9 to 0.6, keep the limits of their lengths.
    """
    tree, found = _parsed(html or "", url or "", 3)
    mined = [r[3:] for r in repeated_items(html, url) if r[2] != "menu"]
    layers = [page_items(html), mined, _priced_items(tree, found)]
    out, seen = [], set()
    for layer in layers:
        for item in layer:
            if item[0] and item[0].lower() not in seen:
                seen.add(item[0].lower())
                out.append(item)
        if out and first_layer:
            break
    return out[:most]


def _rows(pages: DataFrame, page_id: str, url: str, html: str, make, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    def run(batches):
        kinds = [pa.int64(), *(k for _, k, _ in fields)]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows = [(i, *r) for i, u, h in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in make(h, u)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", *(f for f, _, _ in fields)])

    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, " + ", ".join(f"{f} {k}" for f, _, k in fields))


_ITEM = [(f, pa.string(), "string") for f in ("title", "price", "link", "description")] + [("confidence", pa.float64(), "double")]


def mined_items(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 3) -> DataFrame:
    """The records of the repeated subtrees of every page, repeated pages too; one pass, nothing is shuffled."""
    fields = [("region", pa.int32(), "int"), ("position", pa.int32(), "int"), ("kind", pa.string(), "string"), *_ITEM]
    return _rows(pages, page_id, url, html, lambda h, u: repeated_items(h, u, least), fields)


def all_items(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most: int | None = None, first_layer: bool = False) -> DataFrame:
    """The items of all layers of every page, repeated pages too; one pass, nothing is shuffled."""
    return _rows(pages, page_id, url, html, lambda h, u: layered_items(h, u, most, first_layer), _ITEM)
