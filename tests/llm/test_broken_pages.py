from __future__ import annotations

import time

import pytest

from ledgerline.llm import html_extraction as hx

PAGES = {
    "unclosed tags": "<a " * 1_000_000,
    "unclosed tags and an end": "<a " * 1_000_000 + ">",
    "quotes": "<a \"" * 300_001 + ">",
    "quoted ends": '">" <b ' * 200_000 + "'",
    "declarations": "<!" * 1_000_000,
    "deep": "<div>a" * 100_000,
    "deep inline": "<b>" * 200_000 + "<i>" * 200_000 + "</b>" * 200_000 + "x",
    "headings": "<h1>" * 200_000 + "x",
    "closing": "<div>" * 200_000 + "</p></li></td>" * 200_000,
    "references": "&amp" * 500_000,
    "scripts": "<script>" * 200_000,
    "long block": "<article><p>" + "word, " * 500_000 + "</p></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_time_follows_length(name):
    start = time.perf_counter()
    blocks = hx.leaf_blocks(PAGES[name])
    chain = hx.Chain()
    assert len(chain.decode(blocks)) == len(blocks)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p title="a>one</p><p>two</p>', ["one", "two"]),
        ("<p title='x>y' id=\"z>\">one</p>", ["one"]),
        ("a < b <3 <p>c</p>", ["a < b <3", "c"]),
        ("<!doctype html><?x?>a<!-- <p>no</p> --><svg><p>no</p></svg>b", ["ab"]),
        ("<div>a<head>no</head>b</div>", ["a", "b"]),
        ("<a><div>x</div></a>y", ["x", "y"]),
    ],
)
def test_odd_markup(page, texts):
    assert [b.text for b in hx.leaf_blocks(page)] == texts


def test_links_count_where_they_are_open():
    assert [(b.text, b.linked) for b in hx.leaf_blocks("<p>x <a href=1>ab</a> c</p><p><a>def<p>gh")] == [("x ab c", 2), ("def", 3), ("gh", 0)]
