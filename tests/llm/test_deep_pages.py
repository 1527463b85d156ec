"""Pages without limits of depth or tag length."""

import time

import pytest

from statewell.llm import extract
from statewell.llm.pages import parse


def test_depth_does_not_move_text_out_of_its_element():
    page = "<body><article><p>first</p>" + "<blockquote>" * 600 + "deep" + "</blockquote>" * 600 + "<p id=last>after</p></article><footer>end</footer></body>"
    nodes = parse(page)
    article = next(i for i, n in enumerate(nodes) if n.tag == "article")
    last = next(n for n in nodes if n.attrs.get("id") == "last")
    assert last.parent == article
    quotes = [n for n in nodes if n.tag == "blockquote"]
    assert len(quotes) == 600 and all(nodes[n.parent].tag == "blockquote" for n in quotes[1:])
    text = extract.main_text(page, extract.Model())
    assert text.split("\n") == ["first", "deep", "after"]


def test_long_tags_end_where_they_end():
    page = f"<article><p>one</p><img src='data:image/svg+xml,<svg>{'x' * 200_000}></svg>'><p>two</p></article>"
    assert [n.text for n in parse(page) if n.tag == ""] == ["one", "two"]


@pytest.mark.parametrize("page", [
    "<div><font>" * 30_000 + "x" + "</b>" * 30_000, "<b><div>" + "<font>" * 30_000 + "</b>" * 30_000,
    "<i>" * 30_000 + "<div></div>" * 30_000, "<b \"x' > " * 30_000, "<a x='>" * 30_001,
])
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    parse(page)
    assert time.time() - start < 10
