"""Main text of web pages against hand-written pages and an independent reading of the given ones."""

import html
import re
import time

import duckdb
import pytest

from marginflow.llm import main_text
from marginflow.llm.main_text import main_text as text_of

PROSE = "A sentence of some length that an article would hold, and then another one. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p></p><div> \n </div>", ""),
        ("<nav><a href=x>Home</a></nav><script>var a = '<p>no</p>';</script>", ""),
        ("<article><p>That.</p></article><footer>" + PROSE * 9 + "</footer>", "That."),
        ("<p>Only\n \tone   block &amp; no&nbsp;more&#33;", "Only one block & no more!"),
        ("<article><h1>T</h1><p>a</p><div class='ad box'>" + PROSE + "</div><p>b<br>c</p></article>", "T\na\nb c"),
        ("<article><header><h1>Title</h1></header><p>x <b>y</b>z</p><aside>" + PROSE + "</aside></article>", "Title\nx yz"),
        ("<div id=cookie-notice>" + PROSE * 20 + "<article><p>kept</p></article>", "kept"),
        ("<main><p>one<p>two<ul><li>three<li>four</ul></main><section class='comments'><p>" + PROSE, "one\ntwo\nthree\nfour"),
        ("<article><p>said</p><div class=reader-comments><article>" + PROSE * 9 + "</article></div></article>", "said"),
        ("<article>a &lt;p&gt; b <!-- <p>no</p> --> c</article>", "a <p> b c"),
        ("<article><p title='a > b'>kept</p><p hidden>gone</p><form>gone</form></article>", "kept"),
        ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


def test_lines_decide_where_nothing_is_marked():
    """Surge and dive: link lists and short lines around the prose go, short lines inside stay."""
    menu = "".join(f"<div><a href={i}>Entry {i}</a></div>" for i in range(12))
    page = f"<body>{menu}<h1>Title</h1><div>{PROSE}</div><div>Short.</div><div>{PROSE}</div>{menu}<div>Imprint</div></body>"
    assert text_of(page) == "\n".join(["Title", PROSE.strip(), "Short.", PROSE.strip()])
    weak = f"<div>{PROSE * 8}</div>{menu}<div>{PROSE[:70]}</div><div>twenty more letters..</div>"
    assert text_of(weak) == (PROSE * 8).strip()


def test_time_is_linear_in_broken_markup():
    for part in ("<!--", "<a ", '<a x="', "<div>", "</div>", "<p>", "<script>", "<nav>", "<", "&", "<b class=ad>", "</p>"):
        start = time.perf_counter()
        text_of(part * 100_000)
        assert time.perf_counter() - start < 5, part


def test_given_pages(spark):
    """Between <article> tags everything counts; read here by splitting at block tags."""
    folder = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()
    found = {r.page_id: r for r in main_text.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert len(found) == len(pages)
    for page_id, url, page in pages:
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"</?b>", "", b) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        row = found[page_id]
        assert row.text == "\n".join(b for b in blocks if b)
        assert (row.url, row.n_chars) == (url, len(row.text))


def test_awkward_rows(spark):
    rows = [
        (1, "u", "<article>é</article>", "x", "y"),
        (1, "u", "<article>é</article>", "x", "y"),
        (2, None, None, "x", "y"),
        (None, "v", "", "x", "y"),
        (3, "w", "<article>" + PROSE * 20_000 + "</article>", None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    found = sorted(tuple(r) for r in main_text.extract(pages.filter("page_id is not null")).collect() if r.page_id < 3)
    assert found == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]
    assert {r.page_id: r.n_chars for r in main_text.extract(pages).collect()} == {
        1: 1, 2: 0, None: 0, 3: len(PROSE * 20_000) - 1,
    }
    assert main_text.extract(pages.limit(0)).count() == 0
