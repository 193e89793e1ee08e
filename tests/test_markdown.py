"""Markdown of pages: no text is lost, structure is kept, and the work grows with the page."""

import html as h
import random
import re
import time

import pytest

from lodestone.operators.markdown import DROPPED, html_to_markdown, page_markdown

FOLDER = "/root/testdata/sf0.01"


def plain(md):
    """The words of Markdown, without its marks."""
    t = md.replace("\\\n", "\n")
    t = re.sub(r"\\(.)", lambda m: chr(0xE000 + ord(m.group(1))), t)
    t = re.sub(r"\]\([^)\s]*\)", "", t).replace("[", "")
    t = re.sub(r"(?m)^\|(?: --- \|)+$", "", t).replace("|", " ")
    t = re.sub(r"(?m)^`{3,}.*$", "", t)
    t = re.sub(r"(?m)^(?:\s*(?:>|-|[0-9]+\.)(?= |$))+", "", t)
    t = re.sub(r"(?m)^\s*#{1,6} |^\s*---$", "", t)
    t = re.sub(r"[*`]", "", t)
    return re.sub("[\ue000-\ue0ff]", lambda m: chr(ord(m.group()) - 0xE000), t).split()


def force(page):
    t = re.sub(r"(?is)<!--.*?-->", "", page)
    for tag in (*DROPPED, "title"):
        t = re.sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", " ", t)
    t = re.sub(r"(?i)</?(?:b|i|em|strong|a|span|code|u)\b[^>]*>", "", t)
    return h.unescape(re.sub(r"<[^>]*>", " ", t)).split()


def test_all_pages_keep_their_words(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in page_markdown(pages, least=0).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        assert plain(got[r["page_id"]]["markdown"]) == force(r["html"])


CONTAINERS = ["div", "p", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "b", "i", "a", "code", "span", "h2", "dl", "dt", "dd", "pre", "section", "em", "strong", "caption", "thead", "tbody"]


def tree(rng, depth, words, close):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            w = f"w{len(words)}{rng.choice(['', '*', '_', '[', ']', '&lt;', '|', '`', '#', '.', ')'])}"
            words.append(f"w{len(words)}")
            out.append(rng.choice([" ", "\n"]) + w + " ")
        elif kind < 0.42:
            out.append(f"<{(d := rng.choice(DROPPED))}>lost</{d}>")
        elif kind < 0.47:
            out.append(rng.choice(["<br>", "<hr>", "<img alt=x>", "<!-- c -->", "</b>", "</table>", "</li>", "</p>", "</div>"]))
        else:
            tag = rng.choice(CONTAINERS)
            attrs = {"a": rng.choice([' href="/x"', ' href="#y"', ""]), "td": rng.choice(["", " colspan=3", " colspan=x"]), "ol": rng.choice(["", " start=7"])}.get(tag, "")
            out.append(f"<{tag}{attrs}>{tree(rng, depth - 1, words, close)}" + (f"</{tag}>" if rng.random() < close else ""))
    return "".join(out)


@pytest.mark.parametrize("close", [1.0, 0.7, 0.0])
def test_no_text_is_lost(close):
    rng = random.Random(int(close * 10))
    for _ in range(1500):
        words = []
        page = tree(rng, rng.randrange(1, 7), words, close)
        assert re.findall("w[0-9]+", html_to_markdown(page, "http://a.org/", least=0)[0]) == words, page


def test_structure():
    page = """<title> A
      title</title><meta name="Description" content="About x"><h1>Top <a href="../y z">link</a></h1><p>One <b>two <i>three</i></b><br>4 * 5<p># no heading<p>1. no item
      <ul><li>a<ul><li>b<li>c<p>more</ul><li><li>d<ol start=3><li>x<li>y</ol></ul><blockquote>q<p>r</blockquote><pre><code class="language-py">\nif a:\n  ``` b\n</code></pre>
      <table><caption>Cap</caption><tr><th>h<th>k<tr><td>1<td>a|b<tr><td colspan=2>w<p>z</table><table><tr><td>only</table><a href="#f">plain</a> <a href="MAILTO:x@y">mail</a> <a href="http://[bad">bad</a> <code>f(x)</code>"""
    md, title, description, links = html_to_markdown(page, "http://a.org/p/q")
    assert (title, description, links) == ("A title", "About x", 1)
    assert md.split("\n\n") == [
        "# Top [link](http://a.org/y%20z)", "One **two** ***three***\\\n4 \\* 5", "\\# no heading", "1\\. no item", "- a\n  - b\n  - c", "    more\n-\n- d\n  3. x\n  4. y", "> q\n>\n> r",
        "````py\nif a:\n  ``` b\n````", "Cap", "| h | k |\n| --- | --- |\n| 1 | a\\|b |\n| w z |  |", "|  |\n| --- |\n| only |", "plain mail bad `f(x)`",
    ]


def test_short_and_empty_pages():
    assert html_to_markdown(None) == html_to_markdown("") == ("", "", "", 0)
    assert html_to_markdown("<p>" + "x" * 50)[0] == "" and html_to_markdown("<p>" + "x" * 51)[0] == "x" * 51
    assert html_to_markdown("<form><p>in a form</form>out", dropped=["script"], least=0)[0] == "in a form\n\nout"
    assert html_to_markdown('<base href="http://b.org/d/"><a href="e">f</a>', "http://a.org", least=0)[0] == "[f](http://b.org/d/e)"


@pytest.mark.parametrize("part", ["<b>x", "<div>x", "<ul><li>x", "<blockquote>x", "<table><tr><td>x", "<p><a href=/x>t", "x<br>", "<i>x</b>", "<nav><table>x</nav>y", "<td colspan=1000>x"])
def test_time_grows_with_the_page(part):
    began = time.time()
    html_to_markdown(part * 20_000, "http://a.org/")
    assert time.time() - began < 5


def test_rows_of_pages(spark):
    rows = [(1, "http://a.org/", "<h1>One</h1>" + "<p>text here</p>" * 9, "m"), (1, "http://a.org/", "<h1>One</h1>" + "<p>text here</p>" * 9, "m"), (2, None, None, "m"), (None, "u", "short", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, markdown string")
    got = page_markdown(pages).collect()
    assert sorted((r["page_id"] or 0, len(r["markdown"])) for r in got) == [(0, 0), (1, 104), (1, 104), (2, 0)]
    assert page_markdown(pages.limit(0)).collect() == []
