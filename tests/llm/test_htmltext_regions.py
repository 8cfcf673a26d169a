import pytest

from tidelog.llm import htmltext

LONG = "A long paragraph of text that is the content of the page and goes on for a while."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG} 2</p><p>{LONG} 3</p><p>{LONG} 4</p></div></div>", [LONG, LONG + " 2", LONG + " 3", LONG + " 4"]),
        (f"<nav>x</nav><div><article><p>{LONG}</p></article><article><p>{LONG} 2</p><p>{LONG} 3</p></article></div><div>other</div>", [LONG, LONG + " 2", LONG + " 3"]),
        (f"<main><p>{LONG}</p><article><p>{LONG} 2</p><p>{LONG} 3</p></article></main>", [LONG, LONG + " 2", LONG + " 3"]),
        (f"<div class='sidebar-right'><article><p>{LONG}</p></article></div>", [LONG]),
        (f"<div id='search-results'><p>{LONG}</p><p>short</p></div>", [LONG, "short"]),
        (f"<article><p>{LONG}</p></article><div class=sidebar><article><p>{LONG} 2</p></article></div>", [LONG]),
        (f"<div><p>{LONG}</p></div><div id=comments><article><p>{LONG} 2</p><p>{LONG} 3</p></article></div>", [LONG]),
    ],
)
def test_regions(page, want):
    assert htmltext.main_text(page).split("\n") == want
