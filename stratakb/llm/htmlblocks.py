"""Main text of HTML pages by line-block distribution.

The markup is stripped to lines, one for each block of the page, in order.
What the page itself says isn't text has no weight: menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, told by tag, role or
class; scripts and styles make no line at all. Any other line weighs its
characters. The weights are summed over sliding windows of ``WINDOW`` lines.
Where a window's sum rises over the threshold is a surge point, and the run
goes on to the dive point, where a whole window weighs nothing; what lies
between them is kept, a run that never surges is not. The threshold is
``SURGE`` characters, or half of the page's largest window if that is less, so
that a page of little text has a run too.

An article (or main part) that the page marks is a prior on the weights: lines
outside all of them weigh nothing, and within them lines of links count, what is
stripped makes no gap, and a run reaches back to the gap before its surge point.
So an article's short lines stay, neighbouring articles are one run, and a
teaser of few characters far from the others is none. Without a mark, lines that
are mostly links weigh nothing, and a run begins at its surge point.

Defined results: a null or empty page, or one without text, gives "" and 0
characters; repeated rows are worked on each on its own; broken or unclosed
markup never raises and takes time in proportion to the page; extra columns are
kept unless they clash with text and n_chars. There is no shuffle, and a page
is the unit of memory.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
STRAYS = 8  # tags whose quotes don't close before quotes are no longer looked at
SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes object canvas audio video select".split())
ITEMS = frozenset("li dt dd tr td th option".split())
DROPPED = frozenset("nav footer aside form button dialog menu head label input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar "
    "footer footnav sidebar sidebars side rail aside widget widgets cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations teaser teasers comment comments commentlist disqus reply replies respond responses discussion copyright legal disclaimer search form skip".split()
)
#: Words that may stand beside a hint in a class or id without making it something else.
BESIDE = frozenset("bar body bottom box block button buttons container content count group global heading icon inner item items left link links list main notice outer page panel posts primary right row secondary section site slot sub thread title top unit user wrap wrapper area".split())
SAFE = frozenset("html body article main".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)} if text.strip() else {}


def _hinted(value: str) -> bool:
    """Is a class or id of the value made of hints, and of nothing that says otherwise?"""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in HINTS for w in words) and all(w in HINTS or w in BESIDE for w in words):
            return True
    return False


def _dropped(name: str, a: dict[str, str], in_article: bool) -> bool:
    """Does the element hold what isn't main text?"""
    if name in SAFE:
        return False
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    return any(_hinted(v) for v in (a.get("class"), a.get("id")) if v)


class Line:
    __slots__ = ("article", "links", "tag", "text", "used")

    def __init__(self, text: str, links: int, used: bool, article: bool, tag: str):
        self.text, self.links, self.used, self.article, self.tag = text, links, used, article, tag


class Reader:
    """One page's blocks as lines; every step is in proportion to what it reads or closes."""

    def __init__(self, page: str):
        self.page, self.lines = page, []
        self.stack: list[tuple[str, bool, bool]] = []  # name, dropped, marks an article
        self.places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is
        self.blocks: list[int] = []
        self.safe: list[int] = []
        self.dropped = self.anchors = self.articles = self.header = 0
        self.held: list[tuple[str, bool]] = []
        self.strays = 0
        self.endless: set[str] = set()

    def flush(self, tag: str) -> None:
        if self.held:
            text = " ".join(_html.unescape("".join(t for t, _ in self.held)).split())
            if text:
                links = len(" ".join(_html.unescape("".join(t for t, link in self.held if link)).split()))
                self.lines.append(Line(text, links, not self.dropped and not (self.header and tag not in HEADINGS), self.articles > 0, tag))
            self.held.clear()

    def leave(self, k: int) -> None:
        """Close the elements from the k-th on."""
        while len(self.stack) > k:
            name, was, opened = self.stack[-1]
            if name in BLOCKS or was:
                self.flush(name)
            self.stack.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name in SAFE:
                self.safe.pop()
            self.dropped -= was
            self.anchors -= name == "a"
            self.header -= name == "header"
            self.articles -= opened

    def innermost(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def token(self, at: int) -> re.Match | None:
        """The tag, comment or declaration that starts at a <, if one does."""
        if self.page.startswith(("<!", "<?"), at):
            return SKIP.match(self.page, at)
        after = self.page[at + 1 : at + 3]
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/"):
            return None
        if after[:1] == "/" and not (after[1:].isascii() and after[1:].isalpha()):
            return SKIP.match(self.page, at)
        if self.strays < STRAYS:
            if m := TAG.match(self.page, at):
                return m
            self.strays += 1
        return PLAIN_TAG.match(self.page, at)

    def close(self, name: str) -> None:
        if name == "p" and not self.places["p"]:
            self.flush("p")
        at = self.places[name]
        if at and (name in SAFE or not self.safe or at[-1] > self.safe[-1]):
            self.leave(at[-1])

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush(self.innermost())
            if self.blocks and (self.stack[self.blocks[-1]][0] == "p" or self.stack[self.blocks[-1]][0] == name and name in ITEMS):
                self.leave(self.blocks[-1])  # a block ends an open paragraph; an item ends the item before it
        if name in VOID:
            return
        a = _attributes(attributes)
        was = _dropped(name, a, self.articles > 0)
        opened = not self.dropped and not was and (name in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody")
        self.places[name].append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        if name in SAFE:
            self.safe.append(len(self.stack))
        self.stack.append((name, was, opened))
        self.dropped += was
        self.anchors += name == "a"
        self.header += name == "header"
        self.articles += opened

    def raw_end(self, name: str, at: int) -> int:
        """Where to go on after an element whose content is no text."""
        if name not in self.endless:
            if m := re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(self.page, at):
                return m.end()
            self.endless.add(name)
        return len(self.page) if name in ("script", "style", "textarea") else at

    def read(self) -> list[Line]:
        page, pos, n, last = self.page, 0, len(self.page), self.page.rfind(">")
        while pos < n:
            at = page.find("<", pos)
            if at < 0 or at > last and not page.startswith("<!", at):
                self.held.append((page[pos:], self.anchors > 0))
                break
            m = self.token(at)
            if m is None:
                self.held.append((page[pos : at + 1], self.anchors > 0))
                pos = at + 1
                continue
            if at > pos:
                self.held.append((page[pos:at], self.anchors > 0))
            pos = m.end()
            if m.re is SKIP:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            elif name == "br":
                self.held.append((" ", False))
            elif name in RAW:
                if name in BLOCKS:
                    self.flush(self.innermost())
                if not m[3].endswith("/") or name != "svg":
                    pos = self.raw_end(name, pos)
            else:
                self.open(name, m[3])
        self.flush(self.innermost())
        self.leave(0)
        return self.lines


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order; article: within an article or main part."""
    return Reader(page).read()


def marked(lines: list[Line]) -> bool:
    return any(x.article and x.used for x in lines)


def weighed(lines: list[Line], link_share: float = 0.5) -> list[tuple[Line, int]]:
    """The lines of the distribution with the characters of each that count."""
    if marked(lines):
        return [(x, len(x.text) if x.article else 0) for x in lines if x.used or not x.article]
    return [(x, len(x.text) - x.links if x.used and x.links <= link_share * len(x.text) else 0) for x in lines]


def surges(w: list[int], threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) runs of lines: from where the sum of w over a window is over the threshold to where it is 0."""
    out, start = [], None
    total = sum(w[: window - 1])
    for i in range(len(w)):
        total += w[i + window - 1] if i + window - 1 < len(w) else 0
        if start is None and total > threshold:
            start = i
        elif start is not None and total == 0:
            out.append((start, i))
            start = None
        total -= w[i]
    if start is not None:
        out.append((start, len(w)))
    return out


def runs(w: list[int], back: bool, surge: float = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """The runs of a page; back: each with the lines before its surge point that no gap divides from it."""
    sums = [sum(w[i : i + window]) for i in range(len(w))]
    peak = max(sums, default=0)
    out = []
    for a, b in surges(w, min(surge, peak / 2), window):
        while back and a and any(w[max(0, a - window) : a]):
            a -= 1
        out.append((a, b))
    return out


def extract(page: str | None, *, surge: float = SURGE) -> str:
    """The main text: a line for each block, joined by \\n."""
    lines = lines_of(page) if page else []
    found = weighed(lines)
    kept = runs([n for _, n in found], marked(lines), surge)
    return "\n".join(x.text for a, b in kept for x, n in found[a:b] if n)


def extract_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""

    @F.pandas_udf("string")
    def main(values: pd.Series) -> pd.Series:
        return pd.Series([extract(v if isinstance(v, str) else None) for v in values], dtype=object)

    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (html, "text", "n_chars")], main(F.col(html)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
