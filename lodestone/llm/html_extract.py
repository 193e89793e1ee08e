"""Main text of web pages by text-to-tag ratios over streaming parser events.

The standard library's parser turns a page into lines, one for each block of text, with the number of tags that belong to
it and how much of it is the text of links. The ratio of text outside links to tags is smoothed over neighbouring lines by a
Gaussian and clustered by a threshold. The regions that hold the content lines are kept: articles and main elements that have
any, or else the innermost element that has nearly all of them. Within a region a short paragraph stays, whatever its ratio,
while a line made of links stays only alone and in the content cluster. What HTML itself calls boilerplate, and reader comments, never
belong to a region; an element that only its class or id calls boilerplate goes unless it holds most of the content.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA, RADIUS, LEVEL = 1.0, 2, 0.5
LINKS = 0.5  # share of a line from which it is made of links
MOST, NEARLY_ALL = 0.5, 0.8  # shares of the content

#: Fixed: elements by their role in HTML.
BOILERPLATE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea head title dialog menu object canvas audio video fieldset datalist map".split()
)
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Fixed: words of class names and ids that mark boilerplate, those of reader comments, and words that say nothing.
MARK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions sidebar side rail menu menus nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup share sharing social related recommended teaser "
    "teasers footer header masthead topbar toolbar widget widgets pagination pager hidden banner banners skip skiplink search login".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons container content entry form global group holder icon icons id inner item items left link links list main mobile module "
    "outer page panel post posts primary right row secondary section site slot sticky text thread top unit wrap wrapper desktop js no".split()
)
NAME_PARTS = re.compile(r"[a-z]+|\d+")
#: White space of HTML and Unicode alike; a no-break space is one too.
SPACE = re.compile(r"\s+")


def marks(names: str, words: frozenset[str]) -> bool:
    """Whether a class name or id consists of such words, plain words and numbers only."""
    for name in names.split():
        parts = [p for p in NAME_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in PLAIN_WORDS for p in parts):
            return True
    return False


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    tags: int
    region: int  # 0 outside of articles and main elements
    dropped: bool
    marked: int  # the outermost element around it, within its region, that a class or id calls boilerplate, or 0
    place: int  # the element that the line stands in


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, boilerplate, region, marked, number
        self.parents = [0]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.regions = 0

    def state(self) -> tuple[bool, int, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0)

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            dropped, region, marked, place = self.state()
            self.lines.append(Line(text, self.linked, self.tags, region, dropped, marked, place))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS or tag in BOILERPLATE_TAGS:
            self.end_line()
        self.tags += 1
        if tag not in HEAD_TAGS and self.open and self.open[-1][0] == "head":
            self.open.pop()  # anything else ends a head that was not closed
        if tag in VOID_TAGS:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "p":
            self.close("p", within=BLOCK_TAGS - {"p"})
        elif tag == "li":
            self.close("li", within=frozenset({"ul", "ol"}))
        dropped, region, marked, parent = self.state()
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}"
        whole = tag in HEADINGS or tag in ("html", "body")
        if not dropped:
            dropped = not whole and (tag in BOILERPLATE_TAGS or tag == "header" or marks(names, COMMENT_WORDS) or (named.get("role") or "").lower() in BOILERPLATE_ROLES)
            dropped = dropped or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        elif tag == "h1" and region and self.open[-1][0] in ("header", "hgroup") and not any(o[1] for o in self.open if o[0] not in ("header", "hgroup")):
            dropped = False  # the title in an article's own header
        number = len(self.parents)
        self.parents.append(parent)
        if tag in ("article", "main") and not dropped and not region and not marks(names, MARK_WORDS):
            self.regions += 1
            region, marked = self.regions, 0
        elif tag == "h1":
            marked = 0  # a title is none of what a class or id may call its surroundings
        elif not marked and not whole and marks(names, MARK_WORDS):
            marked = number
        self.open.append((tag, dropped, region, marked, number))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.links -= sum(o[0] == "a" for o in self.open[at:])
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag in BOILERPLATE_TAGS:
            self.end_line()
        self.tags += 1
        if tag not in VOID_TAGS:
            # an inline end tag that was never opened must not close a block
            self.close(tag, within=frozenset() if tag in BLOCK_TAGS or tag in BOILERPLATE_TAGS else BLOCK_TAGS)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    out = []
    for at in range(len(values)):
        pairs = [(values[at + k - radius], w) for k, w in enumerate(kernel) if 0 <= at + k - radius < len(values)]
        out.append(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
    return out


def main_text(html: str | None) -> str:
    """The page's content blocks in page order, joined by an empty line; empty if there are none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    HTMLParser.close(parser)
    parser.end_line()
    return "\n\n".join(parser.lines[k].text for k in chosen(parser.lines, parser.parents))


def chosen(lines: list[Line], parents: list[int]) -> list[int]:
    """The lines of the content regions."""
    ratios = smooth([0.0 if x.dropped else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    usable = [k for k, x in enumerate(lines) if not x.dropped]
    articles = [k for k in usable if lines[k].region]
    if articles:
        usable = articles
    if not usable:
        return []
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    limit = min(LEVEL * spread, max(ratios[k] for k in usable))
    content = {k for k in usable if ratios[k] >= limit}
    links = {k for k in usable if lines[k].linked > LINKS * len(lines[k].text)}
    size = lambda k: max(1, len(lines[k].text) - lines[k].linked)
    # marked elements go, but for one with most of what is left
    for _ in range(len({lines[k].marked for k in usable})):
        total, held = sum(map(size, content)), Counter()
        for k in content:
            held[lines[k].marked] += size(k)
        less = {m for m in {lines[k].marked for k in usable} if m and held[m] <= MOST * total}
        if not less:
            break
        usable, content = [k for k in usable if lines[k].marked not in less], {k for k in content if lines[k].marked not in less}
    if not usable:
        return []
    content = content or {max(usable, key=lambda k: ratios[k])}
    if articles:
        regions = {lines[k].region for k in (content - links or content)}
        kept = [k for k in usable if lines[k].region in regions]
    else:
        mass = Counter()
        for k in content:
            place = lines[k].place
            while place:
                mass[place] += size(k)
                place = parents[place]
        # numbers grow inwards: the innermost element with nearly all of the content
        inmost = max((p for p, n in mass.items() if n >= NEARLY_ALL * sum(map(size, content))), default=0)
        kept = []
        for k in usable:
            place = lines[k].place
            while place > inmost:
                place = parents[place]
            if place == inmost:
                kept.append(k)
    return [k for k in kept if k not in links or k in content and not {k - 1, k + 1} & links]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text; a page that is boilerplate only does too. Repeated rows are handled each;
    other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
