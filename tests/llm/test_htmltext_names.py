import time

import pytest

from tidelog.llm import htmltext

LONG = "A long paragraph of text that is the content of the page and goes on for a while."
LINKS = "".join(f"<a href={i}>word</a> " for i in range(30))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{LONG}</p><div class='social-history'><p>{LONG} 2</p></div></article>", [LONG, LONG + " 2"]),
        (f"<article><p>{LONG}</p><div class='related-work'><p>{LONG} 2</p></div><p id='ad-hoc'>{LONG} 3</p></article>", [LONG, LONG + " 2", LONG + " 3"]),
        (f"<article><p>{LONG}</p><p>{LONG} 2</p><div class='social-fruit'>{LINKS}</div><div class='ad-box-2'><p>{LONG} 3</p></div></article>", [LONG, LONG + " 2"]),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG} 2</p></article></main>", [LONG, LONG + " 2"]),
        (f"<body><form action=x><input name=q><label>Find</label><p>{LONG}</p><p>{LONG} 2</p></body>", [LONG, LONG + " 2"]),
        (f"<body><form action=x><input name=q>Find</form><p>{LONG}</p></body>", [LONG]),
        (f"<html><head><title>T</title><meta x><body><p>{LONG}</p>", [LONG]),
        (f"<div class='notice'><p>We have a new office.</p></div><p>{LONG}</p><p>{LONG} 2</p><div class='notice-box'>Closed on Monday.</div>", [LONG, LONG + " 2"]),
        (f"<p>{LONG}</p></b></i></table></x-y><p>{LONG} 2</p>", [LONG, LONG + " 2"]),
    ],
)
def test_names(page, want):
    assert htmltext.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + LONG,
        "<div>" * 100_000 + "</span>" * 100_000 + LONG,
        "<div class='menu-of-week'>" * 60_000 + LONG + "</div>" * 60_000,
        "<x-y>" * 60_000 + "<h1>" * 60_000 + LONG,
        "<section><article>" * 50_000 + LONG,
        "<form>" * 100_000 + LONG,
    ],
)
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    text = htmltext.main_text(page)
    assert text == LONG and time.process_time() - began < 6
