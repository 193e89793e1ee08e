"""Links, titles, structured items and site checks of stored pages."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import host, normal_url, same_site, squeeze


def links(pages: DataFrame, url: str = "url", html: str = "html", limit: int | None = None) -> DataFrame:
    """url, link (absolute where it names a host or a path) and anchor text of every distinct link of a page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>)'))
    rows = pages.select(F.col(url).alias("url"), F.posexplode(found).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?is)href\s*=\s*"([^"]*)"', 1)
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    absolute = F.when(href.rlike(r"^[a-z]+://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("url", r"^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href))
    rows = rows.select("url", "pos", normal_url(absolute).alias("link"), squeeze(F.regexp_replace(F.regexp_extract("a", r"(?is)<a[^>]*>(.*?)</a>", 1), r"<[^>]+>", "")).alias("label")).where("link is not null")
    first = rows.groupBy("url", "link").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))
    if limit is None:
        return first.select("url", "link", "label")
    # links of one page, ranked within the page
    kept = first.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "link", "label"))), 1, limit).alias("found"))
    return kept.select("url", F.explode("found").alias("x")).select("url", F.col("x.link").alias("link"), F.col("x.label").alias("label"))


def internal_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links to the page's own site."""
    return links(pages, url, html).where(same_site("link", host("url")))


def sitemap_locations(xml: str | Column, limit: int = 500) -> Column:
    """The http(s) locations of a sitemap."""
    x = F.col(xml) if isinstance(xml, str) else xml
    return F.slice(F.filter(F.regexp_extract_all(x, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>")), lambda u: u.rlike("^https?://")), 1, limit)


class _Items(HTMLParser):
    """JSON-LD scripts, microdata properties and meta tags."""

    def __init__(self) -> None:
        super().__init__()
        self.scripts: list[str] = []
        self.props: dict[str, str] = {}
        self.meta: dict[str, str] = {}
        self.into: list[str] | None = None
        self.prop: str | None = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "script":
            self.into = [] if named.get("type") == "application/ld+json" else None
        if tag == "meta" and named.get("property") and named.get("content"):
            self.meta.setdefault(named["property"], named["content"])
        if named.get("itemprop"):
            if named.get("content"):
                self.props.setdefault(named["itemprop"], named["content"])
            else:
                self.prop = named["itemprop"]

    def handle_data(self, data):
        if self.into is not None:
            self.into.append(data)
        elif self.prop and data.strip():
            self.props.setdefault(self.prop, data.strip())
            self.prop = None

    def handle_endtag(self, tag):
        if tag == "script" and self.into is not None:
            self.scripts.append("".join(self.into))
            self.into = None


def _flatten(data) -> list[dict]:
    if isinstance(data, list):
        return [x for d in data for x in _flatten(d)]
    if not isinstance(data, dict):
        return []
    if data.get("@type") == "ItemList":
        return [x for e in data.get("itemListElement", []) for x in _flatten(e.get("item", e) if isinstance(e, dict) else e)]
    return [data, *_flatten(data.get("@graph", []))] if data.get("@type") in ("Product", "Article", "NewsArticle") else _flatten(data.get("@graph", []))


def page_items(html: str | None) -> list[tuple[str, str, str, str, float]]:
    """title, price, link, description and confidence: JSON-LD first, then microdata, then meta tags, titles once."""
    if not html:
        return []
    p = _Items()
    p.feed(html)
    out = []
    for text in p.scripts:
        try:
            found = _flatten(json.loads(text))
        except ValueError:
            continue
        for d in found:
            offer = d.get("offers") or {}
            offer = offer[0] if isinstance(offer, list) and offer else offer
            price = " ".join(str(offer[k]) for k in ("price", "priceCurrency") if isinstance(offer, dict) and offer.get(k) is not None)
            out.append((str(d.get("name") or d.get("headline") or "")[:200], price, str(d.get("url") or ""), str(d.get("description") or "")[:300], 0.9))
    if p.props.get("name"):
        out.append((p.props["name"][:200], p.props.get("price", ""), p.props.get("url", ""), p.props.get("description", "")[:300], 0.8))
    if p.meta.get("og:title"):
        out.append((p.meta["og:title"][:200], p.meta.get("product:price:amount", ""), p.meta.get("og:url", ""), p.meta.get("og:description", "")[:300], 0.6))
    seen: set[str] = set()
    return [x for x in out if x[0] and not (x[0] in seen or seen.add(x[0]))]


def items(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id and the structured items of each page."""

    def run(batches):
        for batch in batches:
            rows = [(i, *x) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in page_items(h)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), *[pa.string()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "title", "price", "link", "description", "confidence"])

    return pages.select(F.col(page_id).cast("long"), F.col(html)).mapInArrow(run, "page_id long, title string, price string, link string, description string, confidence double")


def item_chunk(title: Column, price: Column, description: Column, link: Column) -> Column:
    """One line for an item; null if the title is shorter than 2 or the line shorter than 10."""
    line = F.concat_ws(" — ", title, F.when(F.length(price) > 0, F.concat(F.lit("price: "), price)), F.when(F.length(description) > 0, F.substring(description, 1, 200)), F.when(F.length(link) > 0, link))
    return F.when((F.length(title) >= 2) & (F.length(line) >= 10), line)


def detect_site(url: Column, sites: dict[str, str]) -> Column:
    """The site's name by its host, or a domain above it; the longest domain wins."""
    h = host(url)
    out = F.lit(None).cast("string")
    for domain, name in sorted(sites.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when((h == domain) | h.endswith("." + domain), name).otherwise(out)
    return out


def html_text(html: str | Column) -> Column:
    """Tags, scripts and styles removed and common character references decoded, by built-in expressions only."""
    h = F.col(html) if isinstance(html, str) else html
    t = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return squeeze(t)
