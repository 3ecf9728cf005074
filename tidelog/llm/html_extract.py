"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each has its number of words, its link density (share of
words inside links) and those of its neighbours; the unlinked words of the part of the page that holds it; what its
surroundings say about themselves (an element such as ``nav`` or ``article``; a class name such as ``sidebar``, with the share of
the page's words that stand under it, as a name that covers most of a page only describes its layout). A decision
tree, grown on the small labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_rows

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SKIPPED = {"script", "style", "title", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "xmp", "noembed", "audio", "video", "canvas"}
_SKIPPED_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in _SKIPPED}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption button label input".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are no main text wherever they stand; ``header`` only outside the article.
_NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "legend", "option"}
#: Elements whose words together say how much text stands around a block.
_PART = {"div", "td", "th", "section", "article", "main", "body", "center", "form"}
_HINT = re.compile(
    r"(?:^|[-_])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|topbar|footer|foot|sidebar|aside|widgets?|ads?|advert\w*|adsense|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|login|search|copyright|legal|disclaimer|pagination|pager|toolbar|skip|hidden|header)(?:$|[-_\d])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[-_])(?:comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion)(?:$|[-_\d])", re.I)
#: Names that say what a page has, hasn't or allows, or that belong to an article's own title; they name no part of it.
_LAYOUT = re.compile(r"^(?:has|have|with|without|no|not|is|can|js)[-_]|[-_](?:free|less|open|opened|closed|off|on|enabled|disabled)$|^(?:entry|post|article|story|content|title)[-_]header$", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class _Open:
    tag: str
    first: int = 0  # block that it begins with
    end: int | None = None  # block after its last
    strict: bool = False  # the element itself or a comment area says that it is not main text
    hint: _Open | None = None  # nearest element whose class name says so
    part: _Open | None = None  # nearest element of _PART
    article: bool = False
    heading: bool = False
    links: int = 0


@dataclass
class Block:
    text: str
    words: int
    linked: int
    at: _Open
    #: Unlinked words of the page, of the part that holds the block, and of the element whose class name speaks against it.
    page: int = 0
    part: int = 0
    hinted: int = 0

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _opened(tag: str, attributes: str, inside: _Open, first: int) -> _Open:
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    names = [n for n in f"{found.get('class', '')} {found.get('id', '')}".split() if not _LAYOUT.search(n)] if tag not in ("html", "body", "main", "article") else []
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role == "main"
    strict = tag in _NEVER or role in _ROLES or (tag == "header" and not inside.article) or any(_COMMENT.search(n) for n in names)
    strict = strict or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    here = _Open(tag, first, None, strict or inside.strict, None if main else inside.hint, inside.part, inside.article or main, tag in _HEADING or inside.heading, inside.links + (tag == "a"))
    if tag in _PART:
        here.part = here
    if not main and not (tag == "header" and inside.article) and any(_HINT.search(n) for n in names):
        here.hint = here
    return here


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page, in order; character references are decoded and white space is one space."""
    page, out = page or "", []
    root = _Open("")
    root.part = root
    stack, opened, closed = [root], Counter(), [root]
    parts: list[str] = []
    linked, begun = 0, root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, len(text.split(" ")), linked, begun))
        parts, linked = [], 0

    def said(raw: str) -> None:
        nonlocal linked, begun
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not text.isspace():
                if not linked and not any(not p.isspace() for p in parts):
                    begun = stack[-1]
                linked += len(text.split()) if stack[-1].links else 0
            parts.append(text)

    def close(k: int) -> None:
        for element in stack[k:]:
            opened[element.tag] -= 1
            element.end = len(out)
        del stack[k:]

    at = 0
    while m := _TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if not closing and tag in _SKIPPED and not (m[3] or m[6] or "").endswith("/"):
            end = _SKIPPED_END[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if opened[tag]:  # else nothing of that name is open
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
        elif tag not in _VOID and (tag in _BLOCK or tag == "a"):
            if tag in _BLOCK and stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                close(len(stack) - 1)
            if not (m[3] or m[6] or "").endswith("/"):
                stack.append(_opened(tag, m[3] or m[6] or "", stack[-1], len(out)))
                opened[tag] += 1
    said(page[at:])
    flush()
    close(0)
    total = np.r_[0, np.cumsum([b.words - b.linked for b in out], dtype=np.int64)].tolist()
    for b in out:
        b.page, b.part = total[-1], total[b.at.part.end] - total[b.at.part.first]
        b.hinted = total[b.at.hint.end] - total[b.at.hint.first] if b.at.hint else 0
    return out


FEATURES = ("words_before", "words", "words_after", "density_before", "density", "density_after", "words_of_part", "hint", "share_of_hint", "article", "article_on_page", "heading")


def features(page: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; there are none before the first and after the last."""
    words = np.array([0, *(b.words for b in page), 0], dtype=float)
    density = np.array([0, *(b.density for b in page), 0], dtype=float)
    # An article with less than a fifth of the page's words may be a teaser.
    inside = sum(b.words - b.linked for b in page if b.at.article and not b.at.strict)
    article = bool(page) and 5 * inside >= page[0].page and inside > 0
    own = [[b.part, b.at.hint is not None, b.hinted / b.page if b.page else 0, b.at.article, article, b.at.heading] for b in page]
    return np.column_stack([words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:], np.array(own, dtype=float).reshape(len(page), 6)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 12) -> tuple | bool:
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree where <= threshold, tree where above).

    No side of a split has fewer than ``least`` rows. Of equal splits the first feature's smallest threshold counts.
    """
    n, positive = len(y), int(y.sum())
    best = None
    if depth and 0 < positive < n:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            values, left = x[order, f], np.cumsum(y[order])[:-1]
            size = np.arange(1, n)
            right, rest = positive - left, n - size
            impurity = left * (1 - left / size) + right * (1 - right / rest)
            impurity[(values[1:] == values[:-1]) | (size < least) | (rest < least)] = np.inf
            at = int(impurity.argmin()) if n > 1 else 0
            if n > 1 and impurity[at] < (best[0] - 1e-9 if best else np.inf):
                best = (impurity[at], f, float((values[at] + values[at + 1]) / 2))
    if best is None:
        return 2 * positive >= n
    _, f, t = best
    low = x[:, f] <= t
    below, above = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return below if isinstance(below, bool) and below is above else (f, t, below, above)


def decide(tree: tuple | bool, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _fragments(layout: str, rnd: Random) -> Iterator[tuple[str, str]]:
    """A page of a layout: label and markup of its fragments, with numbers of words drawn around those of the table."""
    for part in layout.split():
        mark, tag, sizes = re.fullmatch(r"([-+.])([^:]+)(?::(.*))?", part).groups()
        name = tag.replace("~", " ")
        if mark == ".":
            yield mark, f"<{name}>"
            continue
        said = []
        for size in sizes.split(","):
            n = int(size.lstrip("a"))
            text = " ".join(["word"] * (rnd.randint(1, 11) if n < 12 else rnd.randint(12, 4 * n)))
            said.append(f"<a href='#'>{text}</a>" if size[0] == "a" else text)
        yield mark, f"<{name}>{' '.join(said)}</{tag.split('~')[0]}>"


#: Labelled layouts, one a line: ``+`` is a block of main text and ``-`` any other one (tag:words, ``a`` before linked words, ``~`` for a space), ``.`` a tag by itself.
LABELLED = """
.nav .ul -li:a1 -li:a1 -li:a2 ./ul ./nav -div~class=ad:9 .article +h1:9 +p:60 +p:4 +p:35 +p:1 +p:12 ./article -footer:12
-header:5 .main +h1:7 +p:20,a3,20 +h2:3 +p:80 .ul +li:6 +li:5 ./ul +p:3 ./main .aside -p:50 -p:a3 ./aside -footer:a2,a2,6
-div:7 .article +h1:4 +p:15 +p:a5 +p:40,a6 +blockquote:18 +pre:7 +p:2 .section~class=comments -p:40 -p:9 -p:90 ./section ./article -div:10 -div:30
-div~class=cookie-notice:30 .article +h1:2 +p:2 +p:8 ./article -div:a1,a1,a2 -div~id=footer:40
-p:8 .article +h1:5 +p:3 ./article -p:7 -p:a4
-div~class=ad:9 .article +h1:2 ./article -div:14
-p:7 .article +h1:5 +p:80 +p:60 ./article -p:8 -p:30 -p:a4
-p:30 -p:a3 .main +h1:5 +p:60 +div:40 +div:9 ./main -p:7 -p:60 -p:a4
.nav -p:a1 ./nav .article +h1:2 +p:20 ./article -footer:12 -footer:5
-header:12 .div +h1:4 +p:14 +p:13 ./div -footer:12 .form -p:15 ./form .aside -p:14 ./aside
-header:6 +p:14 +p:16 -footer:12
.article .div~class=text-share-wrap +h1:4 +p:60 +p:8 +p:40 .div~class=share -p:5 ./div ./div ./article -p:7
-p:6 .article +h1:4 .div~id=header-main +p:30 +p:60 ./div ./article .div~class=widget -p:12 ./div
-h2:4 -p:40 .article +h1:5 +p:100 +table:40 +p:3 +h2:3 +p:12 ./article -h3:3 -p:20 -p:8 -p:40
-div:a1,a1,a1 .article +h1:6 +p:30 +p:a3 +p:a4 +p:20 +p:a6 +p:5 ./article -div:20 -p:a3 -p:3
.div~class=page +h1:8 -div:a1,a1,a1,a2 +p:70 +p:14 +p:6 +p:55 ./div .div~class=sidebar -h3:2 -p:60 -p:a3 ./div
.div~class=content-sidebar-wrap .div~class=menu -p:5 -p:a2 ./div +h1:5 +p:90 +p:30 +h2:2 +p:45 +p:3 +p:25 ./div -div:a2,a2
.div~class=site-footer-fixed .div +h1:5 +p:110 +p:18 +p:4 +p:60 ./div .div~class=related -p:a5 -p:a6 -p:a4 ./div ./div
.div~class=sidebar-layout +h1:5 +p:60 +p:70 ./div
.div~class=page +h1:5 +p:60 ./div
.div~class=page +h1:5 +p:60 +p:30 +p:5 +p:40 ./div -div:a2,a1
-div:7 .div~class=story +h1:6 +p:45 +p:9 +p:60 +p:2 +p:38 ./div -div:10 -div:a3 -div:8
-div:3 -div:6 .div +h2:5 +p:120 +p:5 +p:65 ./div -div:9 -div:11 -div:4
-div:7 .div +h1:5 +p:60 +p:40 ./div
.div +h1:5 +p:60 +p:40 ./div -div:9
.table .tr -td:a2 -td:8 .td +h1:4 +p:65 +p:7 +p:90 ./td -td:10 -td:6 ./tr .tr -td:a4 -td:12 ./tr ./table
.table .tr -td:a2,a2,a1 ./tr .tr -td:2 +td:120 -td:11 ./tr .tr -td:5 ./tr ./table
-div:a1,a1,a2,a1 +h1:8 +div:70 +div:40,a4,9 +div:15 +div:55 +div:13 +div:40 -div:a4 -div:a3 -div:3 -div:a5
.ul -li:a1 -li:a2 -li:a1 -li:2 ./ul +h1:4 +p:28 +p:33 +p:5 +p:41 .ul -li:a6 -li:a5 -li:a7 ./ul -p:a2,3
+h1:6 +p:50 +p:42 +h3:3 +p:28 +p:2 +p:33
-div:2 -div:1 -div:3 .div +p:28 +p:33 +p:60 ./div -div:2 -div:1
.div +p:35 +p:4 +p:60 .form -p:6 -p:22 -button:1 ./form +p:38 ./div .div~id=comments -h3:2 -p:30 -p:70 -p:12 ./div
.div~class=banner -p:14 ./div .div +h1:3 +p:36 +p:38 ./div .div~class=newsletter -p:16 ./div .div~class=copyright -p:13 ./div
.div~class=share -p:2 ./div .article .header +h1:5 +p:4 ./header +p:80 .div~class=ad-slot -p:15 ./div +p:50 .div~class=social -p:a2 ./div +p:7 ./article
.nav -a:1 ./nav .div~class=wrapper +h1:3 +p:25 +ul:4 +p:5 +p:200 ./div .div -p:a4 -p:a5 -p:a6 -p:a4 ./div
"""
#: Pages of each layout.
PAGES = 60


def train(labelled: str = LABELLED) -> tuple | bool:
    """The tree that the labelled table gives. Blocks that are strictly no main text are neighbours only."""
    xs, ys = [], []
    for layout in labelled.strip().split("\n"):
        for seed in range(PAGES):
            page = [*_fragments(layout, Random(seed))]
            found, marks = blocks("".join(text for _, text in page)), [mark == "+" for mark, _ in page if mark != "."]
            if len(found) != len(marks):
                raise ValueError(f"{len(found)} blocks and {len(marks)} labels in {layout}")
            xs.append(features(found)[[not b.at.strict for b in found]])
            ys += [mark for b, mark in zip(found, marks, strict=True) if not b.at.strict]
    return grow(np.concatenate(xs), np.array(ys))


def main_text(page: str | None, tree: tuple | bool) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if not b.at.strict and decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html; others are ignored).

    Null, empty and text-free pages give an empty text. Broken markup is read as browsers do: a cut-off
    tag ends with the page, an unclosed script runs to its end. Null ids and repeated rows pass
    through; an empty table gives an empty result. Pages are read whole, in time that grows with their length, however
    deep their elements. Of two equally good splits the tree has the first. A narrow map: nothing is shuffled.
    """
    tree = train()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make, by="html")
