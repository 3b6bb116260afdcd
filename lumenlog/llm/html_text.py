"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those of its neighbours,
and three marks of its surroundings: inside an element named as page furniture, inside an article element, and a
heading. A decision tree, trained on the labelled blocks below, keeps or drops each block.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, texts

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements (fixed values): those that start a block, have no end tag, hold no text of the page, are furniture.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style noscript template textarea title iframe svg math object xmp noembed noframes".split()}
FURNITURE = frozenset("aside button dialog fieldset footer form head header menu nav option select".split())
#: Words in class, id and role names that name furniture (fixed values).
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "copyright disclaimer disqus footer form header hidden login masthead menu menubar modal nav navbar navigation newsletter notice overlay pager "
    "pagination popup promo promoted promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags "
    "toolbar widget".split()
)
_SCOPE = frozenset("article aside body button div dd dl dt fieldset footer form header html li main nav ol section table td th tr ul".split())

#: Labelled blocks: words and link density (in hundredths) of the block, the one before and the one after; inside
#: furniture; inside an article; heading; kept. Blocks of typical news, shop, forum and blog pages.
TRAINING = """
1 100 0 0 1 100 1 0 0 0
1 100 1 100 1 100 1 0 0 0
2 100 1 100 9 0 1 0 0 0
9 0 1 100 8 0 1 0 0 0
14 0 2 100 60 0 1 0 0 0
40 0 12 0 35 0 1 0 0 0
80 5 40 0 0 0 1 0 0 0
6 0 80 0 0 0 1 0 0 0
25 0 120 0 0 0 1 0 0 0
12 20 60 0 0 0 1 0 0 0
30 10 90 0 25 0 1 1 0 0
8 0 45 0 30 0 1 1 0 0
3 100 50 0 4 100 1 1 0 0
55 0 70 0 0 0 1 1 0 0
5 0 90 0 60 0 1 0 1 0
3 0 4 100 20 10 1 0 1 0
7 0 9 0 50 0 0 1 1 1
1 0 8 0 1 0 0 1 1 1
12 0 0 0 90 0 0 1 1 1
4 100 0 0 60 0 0 1 1 1
50 0 7 0 80 0 0 1 0 1
1 0 60 0 90 0 0 1 0 1
2 0 1 0 1 0 0 1 0 1
1 0 1 0 0 0 0 1 0 1
120 4 70 0 90 0 0 1 0 1
300 0 7 0 12 0 0 1 0 1
6 0 300 0 12 0 0 1 0 1
30 35 80 0 70 10 0 1 0 1
20 55 90 0 80 0 0 1 0 1
3 100 60 0 40 0 0 1 0 1
9 0 0 0 0 0 0 1 0 1
1 100 0 0 1 100 0 0 0 0
2 100 1 100 1 100 0 0 0 0
4 100 2 100 3 100 0 0 0 0
12 95 4 100 6 100 0 0 0 0
3 0 2 100 2 100 0 0 0 0
5 40 3 100 12 95 0 0 0 0
9 50 4 100 8 0 0 0 0 0
8 0 9 50 3 100 0 0 0 0
6 0 0 0 1 100 0 0 0 0
4 0 60 0 2 100 0 0 0 0
7 0 5 60 0 0 0 0 0 0
11 45 40 0 6 70 0 0 0 0
8 0 2 100 70 0 0 0 1 1
5 0 60 0 45 0 0 0 1 1
3 0 90 0 80 0 0 0 1 1
4 0 3 100 2 100 0 0 1 0
3 0 50 0 4 100 0 0 1 0
45 0 8 0 60 0 0 0 0 1
70 0 45 0 30 0 0 0 0 1
28 6 90 0 55 0 0 0 0 1
110 2 6 100 80 0 0 0 0 1
35 0 2 100 6 100 0 0 0 1
9 0 60 0 70 0 0 0 0 1
4 0 50 0 45 0 0 0 0 1
1 0 80 0 60 0 0 0 0 1
16 10 70 0 85 0 0 0 0 1
25 0 30 0 20 0 0 0 0 1
26 70 6 100 5 100 0 0 0 0
40 80 30 0 12 95 0 0 0 0
30 0 3 0 60 0 1 0 0 0
45 20 0 0 90 0 1 0 0 0
7 0 2 100 120 0 1 0 0 0
60 0 5 0 40 5 1 0 0 0
2 100 0 0 50 0 1 0 0 0
15 0 80 0 95 0 1 1 0 0
22 0 0 0 4 0 0 1 0 1
5 0 6 0 4 0 0 1 0 1
3 0 2 0 7 0 0 1 0 1
18 0 20 0 15 0 0 1 0 1
60 0 2 0 3 0 0 1 0 1
6 0 2 100 14 0 0 0 1 1
4 0 3 100 22 0 0 0 1 1
5 0 25 0 18 0 0 0 1 1
2 0 0 0 30 0 0 0 1 1
20 0 2 0 2 0 0 0 0 1
22 0 5 0 3 0 0 0 0 1
19 5 6 0 30 0 0 0 0 1
3 0 22 0 24 0 0 0 0 1
5 0 1 100 3 0 0 1 1 1
6 0 2 100 1 0 0 1 0 1
2 0 3 100 0 0 0 1 0 1
9 0 1 100 8 0 0 1 0 1
14 0 20 0 1 100 0 1 0 1
3 0 6 0 2 100 0 1 0 1
1 0 2 100 2 100 0 1 0 1
20 0 1 100 4 100 0 1 0 1
8 100 5 0 4 100 0 1 0 1
4 0 1 100 6 0 0 0 0 0
9 0 2 100 3 100 0 0 0 0
12 0 5 0 2 100 0 0 0 0
3 0 1 100 9 0 0 1 0 1
1 0 1 100 1 0 0 1 0 1
4 0 1 100 40 0 0 1 1 1
2 0 1 100 20 0 0 1 0 1
2 0 1 100 5 0 0 0 0 0
3 0 1 100 12 0 0 0 0 0
"""
FEATURES = 9


@dataclass(frozen=True)
class Node:
    """A test of one feature against a limit, or, without parts, an answer."""

    keep: bool
    feature: int = 0
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by the largest fall of the Gini index; ties go to the first feature and smallest limit."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return Node(bool(share >= 0.5))
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] < limit
            gini = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (low, ~low))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, feature, limit)
    if best is None:
        return Node(bool(share >= 0.5))
    _, feature, limit = best
    low = rows[:, feature] < limit
    return Node(bool(share >= 0.5), feature, float(limit), fit_tree(rows[low], labels[low], depth - 1), fit_tree(rows[~low], labels[~low], depth - 1))


@functools.cache
def trained() -> Node:
    table = np.array([[float(x) for x in line.split()] for line in TRAINING.split("\n") if line])
    return fit_tree(table[:, :FEATURES], table[:, FEATURES].astype(int))


def keeps(tree: Node, row: tuple[float, ...]) -> bool:
    while tree.low is not None:
        tree = tree.low if row[tree.feature] < tree.limit else tree.high
    return tree.keep


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool


#: The mark of what stands in a form or in an element named like furniture: an article or main element in it starts anew.
WRAPPED = 2
#: Names of parts that articles of their own may stand in, which are no main text.
READERS = frozenset({"comment", "comments", "reply", "replies", "respond", "discussion", "related", "hidden"})
#: Names that only say whether the page has such a part.
_WITHOUT = re.compile(r"(?:has|no|with|without)[^a-z]")


class _Page:
    """The flat blocks of a page, gathered while its markup is read once."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, furniture, article, link, heading
        self.open: dict[str, int] = {}
        self.state = (False, False, False, False)
        self.parts: list[str] = []
        self.linked = 0
        self.held = self.state

    def text(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            if not any(p.strip() for p in self.parts):
                self.held = self.state
            if self.state[2]:
                self.linked += len(text.split())
        self.parts.append(text)

    def flush(self) -> None:
        if self.parts:
            found = "".join(self.parts).split()
            if found:
                furniture, article, _, heading = self.held
                self.blocks.append(Block(" ".join(found), len(found), min(self.linked, len(found)), furniture, article, heading))
            self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        self.state = self.stack[-1][1:] if self.stack else (False, False, False, False)

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.open.get("p"):  # a block ends an open paragraph that it does not stand deeper in
                above = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == "p" or self.stack[k][0] in _SCOPE), -1)
                if above >= 0 and self.stack[above][0] == "p":
                    while len(self.stack) > above:
                        self._pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag == "body":
            while self.open.get("head"):
                self._pop()
        if tag in VOID or rest.rstrip().endswith("/"):
            return
        furniture, article, link, heading = self.state
        if tag in ("article", "main") and furniture == WRAPPED:
            furniture = False
        if tag in FURNITURE and not (tag == "header" and article):
            furniture = furniture or (WRAPPED if tag == "form" else True)
        if rest:
            names = " ".join(next(filter(None, m), "") for m in _NAMES.findall(rest)).lower()
            if names and tag not in ("html", "body", "article", "main"):
                parts = {x for name in names.split() if not _WITHOUT.match(name) for x in re.split(r"[^a-z]+", name)}
                if not FURNITURE_NAMES.isdisjoint(parts):
                    furniture = furniture or (WRAPPED if READERS.isdisjoint(parts) else True)
            if "h" in rest and _HIDDEN.search(rest) or "none" in rest and _HIDDEN.search(rest):
                furniture = True
        article = article or tag in ("article", "main")
        link = link or tag == "a"
        heading = heading or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        self.state = (furniture, article, link, heading)
        self.stack.append((tag, *self.state))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and other hidden text are no blocks."""
    out, at = _Page(), 0
    while True:
        found = _MARKUP.search(page, at)
        if not found:
            break
        out.text(page[at : found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag, rest = tag.lower(), found["rest"] or found["rest2"] or ""
        if found["close"] or found["close2"]:
            out.end(tag)
        elif tag in RAW:
            stop = RAW[tag].search(page, at)
            at = stop.start() if stop else len(page)
        else:
            out.start(tag, rest)
    out.text(page[at:])
    out.flush()
    return out.blocks


def main_text(page: str, tree: Node | None = None) -> str:
    """The kept blocks of a page, an empty line between two."""
    tree = tree or trained()
    found = blocks(page)
    shape = [(0.0, 0.0), *((float(b.words), 100 * b.linked / b.words) for b in found), (0.0, 0.0)]
    kept = [
        b.text for k, b in enumerate(found)
        if keeps(tree, (*shape[k + 1], *shape[k], *shape[k + 2], float(bool(b.furniture)), float(b.article), float(b.heading)))
    ]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html): the main text of the whole page.

    A null or empty page has the empty text; null ids and urls stay; repeated rows come out one by one. A page cut
    off within a tag loses the tag, one cut off within a script all of it. Other columns are ignored.
    """
    tree = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = frame([(key, main_text(page, tree)) for key, page in texts(batch)], ["page_id", "text"], ("page_id",))
            out.insert(1, "url", batch["url"].to_numpy())
            yield out

    found = pages.select(F.col("page_id").cast("long"), "html", "url").mapInPandas(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
