"""Pages of a megabyte whose tags would cost a parser that searches its open elements the square of their length."""

import time

import pytest

from sparkboard.llm import html

PIECES = {
    "ends of what is not open": "<b>x</i>", "nested containers": "<div>x", "paragraphs": "<p>some words, here</p>",
    "open lists": "<ul><li>a", "ends of paragraphs": "</p></div>y", "paragraphs in inline": "<span><p>z",
}


@pytest.mark.parametrize("piece", PIECES.values(), ids=PIECES.keys())
def test_time_grows_with_the_page(piece):
    took = []
    for size in (1 << 18, 1 << 20):
        page, start = piece * (size // len(piece)), time.process_time()
        assert html.main_text(page)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1  # four times the page; its square would be sixteen


def test_long_attributes_are_judged_and_not_kept():
    before = html._unwanted.cache_info().currsize
    page = f'<div class="menu" data-x="{"y" * 100_000}">Home, about, contact</div><p>The article, with its words.</p>'
    assert html.main_text(page) == "The article, with its words."
    assert html._unwanted.cache_info().currsize <= before + 1


def test_elements_are_ended_by_what_follows():
    page = "<article><p>One<p>Two <b>bold<i>both</b>left</p><ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>Three</article>"
    assert html.main_text(page) == "One Two boldbothleft a b c d Three"
