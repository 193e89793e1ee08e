"""Items mined from repeated subtrees: planted records are found, articles are left alone, and the work grows with the page."""

import random
import time

import pytest

from lodestone.operators.listings import all_items, layered_items, mined_items, repeated_items

URL = "http://a.org/shop/"
ADVERT = "<div class=ad><p>Buy <i>more</i> now</p></div>"
ARTICLE = "<article><h1>Title</h1><p>One text with <a href=/x>a link</a> in the middle of it.</p><p>Two texts.</p><p>Three <b>texts</b>.</p><p>Four.</p><ul><li>plain<li>points<li>only</ul></article>"
MENU = "<nav><ul><li><a href=/m1>M1</a><li><a href=/m2>M2</a><li><a href=/m3>M3</a></ul></nav>"


def card(rng, k):
    """One record of each layout: HTML of title, price and link, some with optional parts."""
    extra = rng.choice(["", "<p>about <b>it</b></p>", "<span>new</span>"])
    return {
        "cards": f"<div class=c><h3><a href='i{k}'>Item {k}</a></h3><span>{k + 100},000 تومان</span>{extra}</div>",
        "list": f"<li><a href='i{k}'><img src=x></a><a href='i{k}'>Item {k}</a> <b>${k + 100}</b>{extra}",
        "table": f"<tr><td>Item {k}<td><a href='i{k}'>see</a><td>{k + 100} EUR",
        "terms": f"<dt>Item {k}<dd><a href='i{k}'>see</a> {k + 100} USD",
        "headed": f"<h3>Item {k}</h3><p>from € {k + 100}, <a href='i{k}'>see</a></p>",
        "rows": f"<div class=c><h3>Item {k}</h3><a href='i{k}'>see</a><b>{k + 100}$</b></div>",
    }


AROUND = {"cards": ("<div>", "</div>"), "list": ("<ul>", "</ul>"), "table": ("<table><tr><th>name<th>link<th>price", "</table>"), "terms": ("<dl>", "</dl>"), "headed": ("<section>", "</section>"), "rows": ("<div>", "</div>")}


@pytest.mark.parametrize("layout", sorted(AROUND))
def test_planted_records_are_found(layout):
    rng = random.Random(layout)
    wanted = found = right = 0
    for _ in range(60):
        n = rng.randrange(3, 12) if layout != "rows" else 3 * rng.randrange(3, 6)
        parts = [card(rng, k)[layout] for k in range(n)]
        if layout == "rows":
            parts = [f"<div class=row>{''.join(parts[k : k + 3])}</div>" for k in range(0, n, 3)]
        elif layout == "cards" and rng.random() < 0.5:
            parts.insert(rng.randrange(1, len(parts)), ADVERT)
        page = MENU + ARTICLE + AROUND[layout][0] + "".join(parts) + AROUND[layout][1]
        rows = [r for r in repeated_items(page, URL) if r[2] != "menu"]
        want = {(f"Item {k}", f"{URL}i{k}") for k in range(n)}
        got = [(r[3], r[5]) for r in rows]
        assert len({r[0] for r in rows}) <= (n // 3 if layout == "rows" else 1)
        assert all(str(int(r[3].split()[1]) + 100) in r[4] and r[7] == 0.5 for r in rows if r[3].startswith("Item"))
        wanted, found, right = wanted + len(want), found + len(got), right + len(want & set(got))
    assert right >= 0.98 * wanted and right >= 0.98 * found


def test_articles_hold_no_items_and_menus_are_marked():
    rows = repeated_items(MENU + ARTICLE, URL)
    assert [(r[2], r[3], r[5], r[7]) for r in rows] == [("menu", f"M{k}", f"http://a.org/m{k}", 0.2) for k in (1, 2, 3)]
    assert layered_items(MENU + ARTICLE, URL) == []


def test_outer_records_hold_inner_lists():
    page = "".join(f"<div><h3>I{k}</h3><ul><li><a href=/a>a</a><li><a href=/b>b</a><li><a href=/c>c</a></ul></div>" for k in range(3))
    assert [r[3] for r in repeated_items(f"<main>{page}</main>")] == ["I0", "I1", "I2"]


def test_the_rest_of_a_record_is_whole():
    text = "word " * 5000
    page = "<ul>" + "".join(f"<li><b>{k}</b> <a href='#top'>T&amp;{k}</a> {text} 5 EUR" for k in range(3)) + "</ul>"
    for k, r in enumerate(repeated_items(page, URL)):
        assert r[3:7] == (f"T&{k}", "5 EUR", "", f"{k} {text}5 EUR")


def test_layers_add_titles():
    declared = """<script type="application/ld+json">{"@type": "Product", "name": "ITEM 1", "offers": {"price": 7, "priceCurrency": "EUR"}}</script>"""
    lists = "<ul>" + "".join(f"<li><a href=i{k}>Item {k}</a>" for k in range(3)) + "</ul>"
    lone = "<h2><a href=/l>Lone</a></h2><p>only 9 USD</p><p>or 8 EUR</p>"
    rows = layered_items(declared + MENU + lists + lone, URL)
    assert [(r[0], r[1], r[4]) for r in rows] == [("ITEM 1", "7 EUR", 0.9), ("Item 0", "", 0.4), ("Item 2", "", 0.4), ("Lone", "9 USD", 0.4)]
    assert rows[3][2] == "http://a.org/l"
    assert layered_items(declared + lists, URL, first_layer=True) == rows[:1] and layered_items(declared + lists + lone, URL, most=2) == rows[:2]
    assert [r[0] for r in layered_items(lone, URL, first_layer=True)] == ["Lone"]


PARTS = ["<b>x", "<div>x", "<ul><li><a href=x>x", "<li><a href=x>x</a>", "<tr><td>1 USD", "<dt>x<dd>5$", "<h3>x</h3><p>1 EUR", "<p><a href=/x>t", "x<br>", "</b>", "1234567890", "1,", "<i><u>x</u>"]


@pytest.mark.parametrize("part", PARTS)
def test_time_grows_with_the_page(part):
    began = time.time()
    repeated_items(part * 20_000, URL)
    assert time.time() - began < 6


def test_different_siblings_cost_little():
    began = time.time()
    page = "".join(f"<x{k % 5000}><a href=y>t</a></x{k % 5000}>" for k in range(15_000)) + "".join(f"<y{k}>t</y{k}>" for k in range(15_000))
    assert len(repeated_items(page, URL)) == 3
    assert time.time() - began < 6


def test_rows_of_pages(spark):
    page = "<ul>" + "".join(f"<li><a href=i{k}>Item {k}</a>" for k in range(3)) + "</ul>"
    rows = [(1, URL, page, 5.0), (1, URL, page, 5.0), (2, None, None, None), (3, None, "", None), (None, None, page, None), (4, "http://[bad", "<base href='http://[b'>" + page, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, confidence double")
    got = sorted((r["page_id"] or 0, r["position"], r["title"], r["link"]) for r in mined_items(pages).collect())
    links = {0: "i{}", 1: URL + "i{}", 4: ""}
    assert got == sorted((i, k, f"Item {k}", links[i].format(k)) for i in (0, 1, 1, 4) for k in range(3))
    assert len(all_items(pages, most=2).collect()) == 8
    assert mined_items(pages.limit(0)).collect() == all_items(pages.limit(0)).collect() == []
