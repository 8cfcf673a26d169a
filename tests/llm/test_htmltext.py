import html
import re

import pytest

from tidelog.llm import htmltext


def plain(page):
    """The article of the test pages by string cutting."""
    a = page[page.find("<article>") + 9 : page.find("</article>")]
    a = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x01", a)))
    return "\n".join(y for y in (" ".join(html.unescape(z).split()) for z in a.split("\x01")) if y)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = htmltext.op10_htmltext(spark, sf).collect()
    assert len(got) == len(pages)
    assert all(r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><header>Site</header><main><h1>T</h1><p>Hello &amp; <i>you</i><br>there</p><ul><li>One<li>Two</ul><form>x<input></form><aside>s</aside><section class=comments><p>nice</p></section></main><footer>f</footer>", "T\nHello & you there\nOne\nTwo"),
        ("<div id='menu'>m</div><div class='content-with-sidebar'><p>A long paragraph of text that is the content.</p><p>short</p><div class='cookie-notice'>We use cookies</div></div><div class='sidebar'>x</div>", "A long paragraph of text that is the content.\nshort"),
        ("<nav><a href=1>a</a><a href=2>b</a></nav><article><p>Text <span class=ad>buy</span>goes on.</article><div class=ad>An advert that is very long and has no tags inside at all, longer than the article.</div>", "Text goes on."),
        ("plain &lt;b&gt;", "plain <b>"),
        ("<p>a<p>b<table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<![foo[x]]><p>ok</p>", "ok"),
        ("<script>if(a<b)</script><p>z</p><!-- c --><style>p{}</style>", "z"),
        ("<article></article>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page) == want


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, None, None, "x"), (2, "v", "<p>" + "word " * 100_000, "z")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in htmltext.extract(d).collect())
    assert got == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "word word", 499_999)]
    assert htmltext.extract(d.limit(0)).count() == 0
