"""The main text of pages: cases of the contract, windows that decide, hostile markup, and a plain version."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veracol.llm import line_blocks
from veracol.llm.line_blocks import Line, chosen, lines, main_text

LONG = "several words that make a paragraph of the body, with a comma and a stop. " * 4


def test_names_are_read_whole():
    assert main_text("<article><p>a</p><video-player></video-player><p>b</p></article>") == "a\nb"
    assert main_text("<article><p>a</p><head-line>b</head-line><svg-icon></svg-icon></article>") == "a\nb"
    assert main_text('<div class="content no-sidebar"><p>hello world</p></div>') == "hello world"
    assert main_text('<article><p id="search-results">a</p><p>in <button>go</button> line</p></article>') == "a\nin line"
    assert main_text('<article><p>a</p><div class="x ad-slot">b</div><div class=left-sidebar>c</div><section id=comments>d</section></article>') == "a"


def test_windows_decide():
    menu = "<div><ul><li><a href=x>Home</a><li><a href=x>News</a><li><a href=x>Shop</a><li>About</ul></div>"
    notice, foot = "<div>We use small files. Agree.</div>", "<div>Some house, some street</div>"
    page = f"<body>{menu}{notice}<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p></div>{foot}</body>"
    want = "\n".join(["Title", LONG.strip(), "Short.", LONG.strip(), "End."])
    assert main_text(page) == want
    every = [x.text for x in chosen(lines(page), surge=1, dive=0)]
    assert "We use small files. Agree." in every and "Some house, some street" in every
    # A menu without a mark inside the article dives too; links in running text stay.
    assert main_text(f"<article><ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul><p>{LONG}<a>more</a></p></article>") == LONG + "more"


def plain(page: list[Line], window: int, surge: int, dive: int) -> list[str]:
    """Marks each line by the sums of all windows, without the running search."""
    n, count = len(page), [x.count for x in page]
    sums = [sum(count[i : i + window]) for i in range(n)]
    kept, i = [False] * n, 0
    while i < n:
        if sums[i] >= surge:
            top = max(count[i : i + window])
            first = next(k for k in range(i, n) if count[k] == top)
            while first > max(0, i - window) and page[first - 1].count and not kept[first - 1]:
                first -= 1
            last = next((k for k in range(max(i, first), n) if sums[k] <= dive), n)
            while last < n and page[last].count:
                last += 1
            for k in range(first, last):
                kept[k] = True
            i = max(last, i + 1)
        else:
            i += 1
    return [x.text for x, k in zip(page, kept, strict=True) if k and x.text]


def test_stretches_are_those_of_a_plain_search():
    rnd = random.Random(8)
    for _ in range(500):
        page = [Line("x" * n, n * rnd.choice((0, 1, 1)), False) for n in (rnd.choice((0, 0, 5, 30, 90, 200)) for _ in range(rnd.randint(1, 25)))]
        if max((sum(x.count for x in page[i : i + 3]) for i in range(len(page))), default=0) >= 180:
            assert [x.text for x in chosen(page, 3, 180, 150)] == plain(page, 3, 180, 150)


@pytest.mark.parametrize("piece", ["<script", "<a '", '<a "', "<!--", "<", "</", "<b class=ad>", "<p>a", '<div class="a b">x', "<title>", "&#", "<a href='>'>"])
def test_time_grows_with_the_page(piece):
    began = time.perf_counter()
    main_text(piece * (400_000 // len(piece)) + ">")
    assert time.perf_counter() - began < 10


def test_whole_query_against_articles_cut_out(spark):
    sentence = lambda i: f"Sentence {i} says &eacute; &amp; more.  It goes on\n\tand on."
    rows = []
    for i in range(40):
        body = [f"Head {i}", *[sentence(i * 10 + k) * (1 + k % 3) for k in range(i % 7)], "End."]
        page = f"<html><head><title>t</title></head><body><nav><a>m</a></nav><div class=ad>{LONG}</div><article><h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:]) + "</article><footer>f</footer></body></html>"
        rows.append((i, "u", page))
    rows += [(100, "u", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"), (101, None, ""), (102, "u", None), (0, "u", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = line_blocks.extracted(pages).collect()
    assert len(got) == len(rows)

    def want(page):
        inside = re.search("<article>(.*)</article>", page or "", re.S)
        blocks = re.findall(r"<(?:p|h1)>(.*?)</(?:p|h1)>", inside[1], re.S) if inside else []
        return "\n".join(re.sub(r"\s+", " ", b.replace("&eacute;", "é").replace("&amp;", "&")).strip() for b in blocks)

    texts = {r[0]: want(r[2]) for r in rows}
    assert all(r.text == texts[r.page_id] and r.n_chars == len(r.text) for r in got)
