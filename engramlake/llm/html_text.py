"""Main text of web pages by text-to-tag ratios of lines, from the standard library's streaming parser.

The parser's events make lines: text between tags that break the flow, with the tags that stood in it. A line's ratio
is its text's length by its number of tags; what a page names its article or main part weighs MAIN_WEIGHT times as much,
a help that ratios need no more than that. Ratios are smoothed with a Gaussian over neighbouring lines, so that short
lines among long ones count as content and single long ones among menus don't. Lines beyond a threshold (a share of the
ratios' standard deviation), both smoothed and by themselves, are the cores of clusters, and the regions that hold a core
are the content: a named part whole, whatever its lines' ratios; else a section, with the sections below their common
parent (if that isn't the page's body) that are in the same smoothed cluster or stand between cores. No line of a chosen region is left out. Every page has a
core: the line with the largest ratio is one by necessity.

Elements that are never content by their name or role (menus, page headers and footers, sidebars, forms, scripts, hidden
ones) and those whose class or id says nothing else than that (adverts, notices, comments, related links) make no lines.
In a named part headers and notices are its own, and what a heading's id says is its subject.

Null and empty html gives an empty text, as does a page without content. Unclosed elements end with their parents.
Repeated rows give repeated results; an empty table gives no rows. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

PAGES = "page_id long, url string, text string, n_chars long"
SIGMA, THRESHOLD, MAIN_WEIGHT = 1.0, 0.5, 10

# Names of the markup language, and words that classes and ids have.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg template textarea audio video".split())
SECTIONS = frozenset("article body div main section td".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended"
    " related replies reply responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that say nothing against what is in the article or main part: its title stands in its header.
OWN_IN_MAIN = frozenset("banner header masthead notice notices".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the same kind ends where one of these begins.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
PART = re.compile(r"[a-z]+")
#: What may stand beside such a word in a name that says no more than the word.
BESIDE = frozenset(
    "a area article articles bar block body bottom box btn button buttons center col column container content first full group head icon icons inner item items js last left"
    " link links list main mobile module outer page panel post posts right row section side site slot small sticky story stories text title top unit wrap wrapper zone".split()
)


@lru_cache(maxsize=10_000)
def _names_boilerplate(value: str, main: bool = False) -> bool:
    """Whether one of the names, as of classes, has a word of WORDS and none but those and such as stand beside them."""
    words = WORDS - OWN_IN_MAIN if main else WORDS
    parts = (PART.findall(name.lower()) for name in value.split())
    return any(not words.isdisjoint(p) and all(x in WORDS or x in BESIDE for x in p) for p in parts)


class Lines(HTMLParser):
    """lines: [text, number of tags, section, number of the named part or 0]; parents: of each section."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # name, no content, section, named part
        self.names: Counter[str] = Counter()  # of what is open
        self.lines: list[list] = []
        self.text: list[str] = []
        self.parents = [0]
        self.tags = 0
        self.out, self.section, self.main = False, 0, 0

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append([text, self.tags, self.section, self.main])
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not self.out:
            self.tags += 1
            if tag in BREAKS:
                self.flush()
        if tag in VOID:
            return
        if tag in ENDS and self.open and self.open[-1][0] in ENDS[tag].split():
            self.close_last()
        self.open.append((tag, self.out, self.section, self.main))
        self.names[tag] += 1
        if self.out:
            return
        if tag in NEVER or tag == "header" and not self.main or attrs and self.hidden(tag, attrs):
            self.flush()
            self.out = True
        elif tag in SECTIONS:
            self.parents.append(self.section)
            self.section = len(self.parents) - 1
            if not self.main and (tag in MAIN or any(k == "role" and v == "main" for k, v in attrs)):
                self.main = self.section

    def hidden(self, tag: str, attrs: list) -> bool:
        if tag in ("body", "html"):
            return False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ROLES:
                return True
            named = k in ("class", "id") and tag not in MAIN and not (self.main and k == "id" and tag in HEADINGS)
            if v and (named and _names_boilerplate(v, bool(self.main)) or k == "style" and "display:none" in v.replace(" ", "").lower()):
                return True
        return False

    def close_last(self) -> None:
        tag, out, self.section, self.main = self.open.pop()
        self.names[tag] -= 1
        if self.out and not out:
            self.text = []
        self.out = out

    def handle_endtag(self, tag: str) -> None:
        if not self.out:
            self.tags += 1
            if tag in BREAKS:
                self.flush()
        if self.names[tag]:
            while self.open[-1][0] != tag:
                self.close_last()
            self.close_last()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """By a Gaussian whose weights within the page add up to one."""
    import numpy as np

    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    x = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return x / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return " ".join(x[0] for x in content(parser.lines, parser.parents))


def content(lines: list[list], parents: list[int]) -> list[list]:
    """The lines of the regions that hold a core."""
    import numpy as np

    if not lines:
        return []
    ratios = np.array([len(x[0]) / max(1, x[1]) * (MAIN_WEIGHT if x[3] else 1) for x in lines])
    soft, least = smoothed(ratios), THRESHOLD * np.std(ratios)
    near = soft >= least
    core = np.flatnonzero(near & (ratios >= least))
    named, sections = {lines[i][3] for i in core} - {0}, {lines[i][2] for i in core}
    # Sections of smoothed clusters that reach a core: neighbouring lines, one after the other.
    runs = np.cumsum(np.r_[True, near[1:] != near[:-1]])
    held = set(runs[core].tolist())
    joined = {x[2] for x, run, ok in zip(lines, runs.tolist(), near.tolist()) if ok and run in held}
    # By section: the first and the last core in it or in any section below.
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in core.tolist():
        at = lines[i][2]
        while True:
            first.setdefault(at, i)
            last[at] = i
            if not at:
                break
            at = parents[at]

    def beside(i: int, section: int) -> bool:
        up = parents[section]
        return up > 1 and up in first and (section in joined or first[up] < i < last[up])  # 0 is the page, 1 its body

    return [x for i, x in enumerate(lines) if (x[3] in named if x[3] else x[2] in sections or beside(i, x[2]))]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PAGES)
