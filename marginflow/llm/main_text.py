"""The main text of web pages by the distribution of text over lines.

Markup is stripped first: scripts, styles, comments and tags go, and each block becomes a line.
Elements that never hold an article (menus, page headers and footers, sidebars, notices, adverts, forms,
reader comments, told by tag, role, class and id) leave only blank lines; inside an article they leave
nothing, so that it isn't torn.  A line weighs its characters outside links.  Where the page itself marks an
article, its lines weigh ``BOOST`` times all their characters and the others nothing.  The weights of
``WINDOW`` lines are summed at each line: a block of lines starts where the sums surge past a
threshold and ends where they dive to nothing.  The lines of these blocks are the text; on pages
without a marked article, blocks whose peak is far below the page's highest are left out.

One row is read at a time with one pass over its markup, in time proportional to its length.

Cases: null, empty and text-free pages give an empty text; an element that is never closed ends with
its parent or where an article starts; a page without any marked article is decided by its lines alone;
repeated rows give a row each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines whose weights are summed, and blank lines that a removed element leaves.
WINDOW = 3
#: Weight from which sums surge; on pages with less text, half of the highest sum.
SURGE = 86
BOOST = 100
#: Blocks whose peak is below this share of the page's highest are left out.
SHARE = 0.2

# Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REMOVED = frozenset("head nav aside footer form button dialog menu search fieldset label audio video canvas".split())
ARTICLES = frozenset("article main".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status".split()
)
#: Words of a class or id that tell what an element holds.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices "
    "popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s\"'>]++)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements that a sibling of the same kind ends.
_SIBLINGS = frozenset("li dt dd option tr td th p".split())
_STAYS = frozenset("html body article main".split())


def _told(attributes: str) -> bool:
    """Whether class, id or role tell an element that holds no article."""
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), "".join(values).lower()
        if kind in ("hidden", "aria-hidden"):
            if kind == "hidden" or value == "true":
                return True
        elif kind == "role":
            if value.strip() in ROLES:
                return True
        elif not NAMED.isdisjoint(_NAME.findall(value)):
            return True
    return False


class Lines:
    """Lines of a page and their weights."""

    def __init__(self):
        self.text: list[str] = []
        self.weight: list[int] = []
        self.marked: list[bool] = []
        self._parts: list[str] = []
        self._plain = 0

    def add(self, text: str, link: bool) -> None:
        self._parts.append(text)
        if not link:
            self._plain += len(text) - text.count(" ")

    def close(self, article: bool, title: bool = False) -> None:
        """Ends the line; a title is part of what follows."""
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                weight = BOOST * len(text) if article else min(self._plain, len(text))
                self.text.append(text)
                self.weight.append(weight + SURGE * title)
                self.marked.append(article)
            self._parts, self._plain = [], 0

    def gap(self) -> None:
        self.text += [""] * WINDOW
        self.weight += [0] * WINDOW
        self.marked += [False] * WINDOW

    def weights(self) -> list[int]:
        """Weights; a marked article leaves none to other lines."""
        if not any(self.marked):
            return self.weight
        return [w if m else 0 for w, m in zip(self.weight, self.marked)]


def lines_of(page: str) -> Lines:
    """Blocks of a page as lines."""
    lines, at, size = Lines(), 0, len(page)
    stack: list[tuple[str, bool, bool]] = []  # name, removed, article: of the element or one above
    depth: Counter[str] = Counter()
    removed = article = link = False

    def leave(name: str) -> None:
        """Closes elements up to the innermost ``name``."""
        nonlocal removed, article, link
        while True:
            top, was_removed, was_article = stack.pop()
            depth[top] -= 1
            above_removed, above_article = stack[-1][1:] if stack else (False, False)
            if not removed:
                if top in BLOCKS:
                    lines.close(article, top == "h1")
            if (was_removed and not above_removed and not above_article) or (was_article and not above_article):
                lines.gap()
            removed, article = above_removed, above_article
            if top == name:
                return

    while at < size:
        tag = _TAG.search(page, at)
        start = tag.start() if tag else size
        if start > at and not removed:
            lines.add(page[at:start], link)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:  # an end tag
            if name == "a":
                link = False
            elif name == "br":
                if not removed:
                    lines.add(" ", link)
            elif depth[name]:
                if name in BLOCKS:
                    link = False
                leave(name)
            elif name == "p" and not removed:
                lines.close(article)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not tag[3].rstrip().endswith("/"):
                at = page.find(">", end.end() - 1) + 1 if end else size
                at = at or size
            continue
        if name in VOID:
            if not removed and name != "wbr":
                lines.add(" ", link)
            if name == "hr" and not removed:
                lines.close(article)
            continue
        if name == "a":
            link = True
            continue
        if name in BLOCKS:
            if depth["p"] and stack and stack[-1][0] == "p":
                leave("p")
            if name in _SIBLINGS and stack and stack[-1][0] == name:
                leave(name)
            if not removed:
                lines.close(article)
            if name in ("p", "article", "main", "div", "section"):
                link = False
        if name == "body" and depth["head"]:
            leave("head")
        drops = name not in _STAYS or name == "article"
        drops = drops and (
            name in REMOVED or (name == "header" and not article) or (bool(tag[3].strip()) and _told(tag[3]))
        )
        if name in ARTICLES and not drops and removed and not article:
            # what is still open above was never closed: an article is in no menu
            while removed and stack:
                leave(stack[-1][0])
        if name in BLOCKS or drops:
            inside = article or (name in ARTICLES and not drops)
            if (drops and not removed and not article) or (inside and not article):
                lines.close(article)
                lines.gap()
            stack.append((name, removed or drops, inside))
            depth[name] += 1
            removed, article = removed or drops, inside
    if not removed:
        lines.close(article)
    return lines


def blocks(weight: list[int], share: float) -> list[tuple[int, int]]:
    """(first, behind last) line of each block between a surge and a dive; peaks reach ``share`` of the highest."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    peak = max(sums, default=0)
    if not peak:
        return []
    surge = min(SURGE, peak / 2)
    found, at, n = [], 0, len(weight)
    while at < n:
        if sums[at] < surge:
            at += 1
            continue
        dive = at
        while dive < n and sums[dive]:
            dive += 1
        first = at
        # light lines before the one that makes the sums surge are not yet the block
        while weight[first] * WINDOW < surge:
            first += 1
        if max(sums[at:dive]) >= share * peak:
            found.append((first, dive))
        at = dive
    return found


def main_text(page: str) -> str:
    """The lines of a page's main text, joined by line feeds."""
    lines = lines_of(page)
    share = 0.0 if any(lines.marked) else SHARE
    kept = [lines.text[i] for low, high in blocks(lines.weights(), share) for i in range(low, high)]
    return "\n".join(line for line in kept if line)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py() or "") for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = ", ".join([f"{c} {k}" for c, k in kinds.items()] + ["text string", "n_chars long"])
    return pages.select("page_id", "url", F.col("html")).mapInArrow(read, schema)
