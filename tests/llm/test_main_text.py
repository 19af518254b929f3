"""Line-block distribution: against a plain restatement, on pages where the window decides, and in time."""

import random
import time

import duckdb
import pytest

from stratakb.llm import htmlblocks

LONG = "This sentence is long enough to be the text of a page and says a little more than that. "


def plain_runs(w, back, surge=80, k=3):
    """Lines to keep, by the definition: a surging window opens, an empty window closes."""
    windows = [sum(w[i : i + k]) for i in range(len(w))]
    limit, keep, inside = min(surge, max(windows, default=0) / 2), set(), False
    for i, s in enumerate(windows):
        if not inside and s > limit:
            inside, j = True, i
            while back and j > 0 and any(w[max(0, j - k) : j]):
                j -= 1
                keep.add(j)
        elif inside and s == 0:
            inside = False
        if inside:
            keep.add(i)
    return keep


def test_runs_equal_the_definition():
    r = random.Random(2)
    for _ in range(2000):
        w = [r.choice([0, 0, 0, r.randrange(12), r.randrange(300)]) for _ in range(r.randrange(30))]
        for back in (False, True):
            got = {i for a, b in htmlblocks.runs(w, back) for i in range(a, b) if w[i]}
            assert got == {i for i in plain_runs(w, back) if w[i]}


def test_the_window_decides():
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "News", "Shop", "Us"))
    far = "<div><a href=/>x</a></div>" * 4
    page = f"<body>{menu}{far}<p>{LONG * 3}</p><p>A short end.</p>{far}<div>Written by no one</div></body>"
    assert htmlblocks.extract(page) == f"{(LONG * 3).strip()}\nA short end."
    every = htmlblocks.weighed(htmlblocks.lines_of(page))
    assert "\n".join(x.text for x, n in every if n) != htmlblocks.extract(page)  # all that weighs is not the text
    far = "<div>Out of it</div>" * 4
    page = f"<article><h1>Title</h1><p>{LONG}</p></article>{far}<article><a href=/>Next one</a></article>"
    assert htmlblocks.extract(page) == f"Title\n{LONG.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}</p></article><article><p>Second, short.</p></article>", f"{LONG.strip()}\nSecond, short."),
        (f"<article><div class='form-text'><p>{LONG}</p></div></article>", LONG.strip()),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", "So x=1 holds."),
        (f"<p>{LONG}</p><p>The end.</p>", f"{LONG.strip()}\nThe end."),
        (f"<article><p>One.</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>{LONG}</p><div class='ad-box'>Buy</div><p>Two.</p></article>", f"One.\n{LONG.strip()}\nTwo."),
        (f"<article><p>{LONG}</p><section class='comments-list'><p>{LONG}</p></section><div id='respond'>Reply</div></article>", LONG.strip()),
        ("<article><p>Tiny.</p></article><footer>f</footer>", "Tiny."),
        ("a < b and c > d <p>x", "a < b and c > d\nx"),
    ],
)
def test_pages(page, text):
    assert htmlblocks.extract(page) == text


@pytest.mark.parametrize(
    "page",
    ["<a '" * 250_000, "<div>" * 80_000 + "</p>x" * 80_000, "<article>" + "<span>" * 60_000 + "</div>" * 90_000, "<b>" * 60_000 + "<p>x" * 80_000, "<svg>" * 200_000, "<a href=\"" * 110_000 + ">", "<!--" * 250_000, "</" * 500_000, "<a b='" * 160_000 + "'>x", "<" * 1_000_000, "<li>" * 250_000],
    ids=range(11),
)
def test_broken_pages_take_linear_time(page):
    began = time.time()
    htmlblocks.extract(page)
    assert time.time() - began < 4


def test_whole_pages_are_their_articles():
    """The driver's pages mark their articles: all blocks of those, and no others, by a plain reading of the markup."""
    import html
    import re

    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote)(?:\s[^>]*)?>", inside)]
        if re.search(r"<(?:aside|form|script|nav|section)|class=", inside):
            continue
        assert htmlblocks.extract(page) == "\n".join(b for b in blocks if b)
