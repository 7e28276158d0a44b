"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags; each has its word count and link density and
those of its neighbours (Kohlschuetter et al., 2010). Four facts of the markup are further features: the block lies in an element for
navigation, footers, side bars or forms; in a wrapper whose class names such a region and nothing else; in one whose class has such a word
among others ("related-work"), which is only a hint; in an article, or beside the one that the page has. A CART
tree trained on the labelled table below decides; the blocks it accepts are the text. Class names of a wrapper end
at an article or main element in it, unless they are of what holds articles of its own (comments, related, adverts: FOREIGN).

Defined cases: null or empty html gives the empty text; unclosed and stray tags are tolerated; html without
tags is one block; script, style and form content is never text; a self-closed element is empty; of a RAW element without an end
tag only the tag is skipped, but script and style run to the end of the page; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names with a meaning in HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "select", "option", "svg", "math", "iframe", "object", "canvas", "audio", "video", "button")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
REGION = {"article", "aside", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul", "head"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "fieldset", "head"}
# Words of class names.
NAMED = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscri\w*"
    r"|comments?|replies|disqus|respond|share|sharing|social|related|recommend\w*|widget|pagination|pager|toolbar|login|signup|search)", re.I)
#: Words that name no region and no content, so that "site-header" is a header, but "related-work" is not what is related.
NEUTRAL = re.compile(
    r"(?:site|page|main|top|bottom|left|right|side|bar|user|reader|global|primary|secondary|list|area|slot|box|wrap|wrapper|container|inner|outer|block|section|item|items|group|panel|unit|posts?"
    r"|articles?|links?|icons?|buttons?|form|the|js|col|row|[a-z]?\d*)", re.I)
#: Names of regions with articles of their own.
FOREIGN = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies|disqus|respond|related|recommend\w*|widget)", re.I)
#: A class that says what a page has or lacks names no region.
STATE = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S+", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<inside>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>", re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")  # the slash belongs to a value
ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ("prev_words", "prev_links", "words", "links", "next_words", "next_links", "element", "named", "hinted", "article", "beside_article")

# Neighbours: words and link density.
NONE, MENU, SHORT, LONG = (0, 0.0), (2, 1.0), (7, 0.0), (50, 0.0)
ANY = (NONE, MENU, SHORT, LONG)
PLAIN, LINKED = (0.0, 0.1), (0.6, 1.0)

#: The labelled table in short: each line stands for the blocks of all combinations of its values.
#: Regions ("" for none of element, named, hinted), places (in the article, beside it, no article on the page), block before, words, links, block after, label.
TABLE = (
    (("element", "named"), ("in", "beside", "none"), ANY, (2, 9, 30, 90), (0.0, 0.1, 1.0), ANY, 0),
    (("", "hinted"), ("beside",), ANY, (2, 9, 30, 90), (0.0, 0.1, 1.0), ANY, 0),
    # In the article: text of any length, and long links between paragraphs.
    (("",), ("in",), ANY, (1, 3, 7, 12, 20, 60, 150), (0.0, 0.1, 0.3), ANY, 1),
    (("",), ("in",), ANY, (20, 60), (0.5,), ANY, 1),
    (("",), ("in",), (LONG,), (12, 20), LINKED, (LONG,), 1),
    (("",), ("in",), ANY, (60, 150), LINKED, ANY, 1),
    (("",), ("in",), ANY, (1, 3, 6, 8), LINKED, ANY, 0),
    (("",), ("in",), (NONE, MENU, SHORT), (12, 20), LINKED, (NONE, MENU, SHORT), 0),
    # Hinted at: long blocks, and short ones before those.
    (("hinted",), ("in", "none"), ANY, (20, 60, 150), PLAIN, ANY, 1),
    (("hinted",), ("in", "none"), ANY, (2, 6, 10), PLAIN, (LONG,), 1),
    (("hinted",), ("in", "none"), ANY, (2, 6, 10), PLAIN, (NONE, MENU, SHORT), 0),
    (("hinted",), ("in", "none"), ANY, (2, 6, 20, 60, 150), LINKED, ANY, 0),
    # No article on the page: long blocks, and short ones beside those or among their like.
    (("",), ("none",), ANY, (20, 60, 150), (0.0, 0.1, 0.3), ANY, 1),
    (("",), ("none",), ANY, (2, 6, 10), PLAIN, (LONG,), 1),
    (("",), ("none",), (NONE, SHORT, LONG), (2, 6, 10), PLAIN, (NONE, SHORT), 1),
    (("",), ("none",), (MENU,), (2, 6, 10), PLAIN, (NONE, MENU, SHORT), 0),
    (("",), ("none",), (NONE, SHORT), (2, 6, 10), PLAIN, (MENU,), 0),
    (("",), ("none",), (LONG,), (2, 6, 10), PLAIN, (MENU,), 1),
    (("",), ("none",), ANY, (2, 6, 10, 20, 60, 150), LINKED, ANY, 0),
)


def table() -> list[tuple]:
    """The blocks of TABLE, one a row: FEATURES and then 1 for main text."""
    return [(*before, words, links, *after, *(region == r for r in FEATURES[6:9]), place == "in", place == "beside", label)
            for regions, places, befores, many, shares, afters, label in TABLE
            for region, place, before, words, links, after in product(regions, places, befores, many, shares, afters)]


def named(classes: list[str]) -> tuple[bool, bool, bool]:
    """Whether class names name another region, whether that is one with articles of its own, and whether they have such a word at all."""
    strong = foreign = weak = False
    for token in STATE.sub(" ", " ".join(classes)).split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        words = ["sidebar" if w == "side" and "bar" in words else w for w in words]
        if any(map(NAMED.fullmatch, words)):
            weak = True
            if all(NAMED.fullmatch(w) or NEUTRAL.fullmatch(w) for w in words):
                strong, foreign = True, foreign or any(map(FOREIGN.fullmatch, words))
    return strong, foreign, weak and not strong


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16) -> tuple | float:
    """A CART tree by Gini impurity: (feature, threshold, at most, above), or the share of label 1."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = y[x[:, f] <= t]
            high = y[x[:, f] > t]
            gini = sum(len(part) * part.mean() * (1 - part.mean()) for part in (low, high))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best is None:
        return float(y.mean())
    _, f, t = best
    at_most = x[:, f] <= t
    return f, t, grow(x[at_most], y[at_most], depth - 1), grow(x[~at_most], y[~at_most], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple:
    rows = np.array(table(), float)
    return grow(rows[:, :-1], rows[:, -1])


def accepted(row: tuple, node: tuple | float) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool, bool]]:
    """The page's text blocks in order: text, words, link density, and whether it lies in an element apart, named apart, hinted at, in an article."""
    out: list[tuple[str, int, float, bool, bool, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    link_depth = 0
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []
    tagged = layout = foreign = hinted = article = False  # apart by element, by a wrapper's class, by a class of FOREIGN; hinted at; in an article
    endless: set[str] = set()

    def end_block() -> None:
        nonlocal linked
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(1.0, linked / len(words)), tagged, layout or foreign, hinted, article))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if link_depth:
                linked += len(entities.unescape(piece).split())

    at = 0
    while m := TAG.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        raw = (m["raw"] or "").lower()
        if raw:
            closed = m["inside"].endswith("/") and not UNQUOTED.search(m["inside"])
            if not closed and raw not in endless:
                end = RAW_END[raw].search(page, at)
                if end:
                    at = end.end()
                elif raw in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(raw)
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            link_depth = 0 if m["end"] else 1
        if name in BLOCK:
            end_block()
            link_depth = 0
        if name not in REGION or (m["attr"] or "").endswith("/"):
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, tagged, layout, foreign, hinted, article = stack[k]
                    del stack[k:]
                    break
        else:
            stack.append((name, tagged, layout, foreign, hinted, article))
            tagged = tagged or name in APART
            if name in ("article", "main"):
                layout, hinted, foreign, article = False, False, foreign and name == "article", True
            elif name != "body":
                strong, of_articles, weak = named([" ".join(filter(None, a)) for a in ATTR.findall(m["attr"] or "")])
                layout, foreign, hinted = layout or strong, foreign or of_articles, hinted or weak
    text(page[at:])
    end_block()
    return out


def rows_of(found: list[tuple]) -> list[tuple]:
    """The FEATURES of each block."""
    has_article = any(b[6] and not (b[3] or b[4]) for b in found)
    none = ("", 0, 0.0)
    beside = zip([none, *found[:-1]], found, [*found[1:], none])
    return [(p[1], p[2], b[1], b[2], n[1], n[2], b[3], b[4], b[5], b[6], has_article and not b[6]) for p, b, n in beside]


def main_text(page: str | None, root: tuple | None = None) -> str:
    found, root = blocks(page or ""), root or tree()
    return " ".join(b[0] for b, row in zip(found, rows_of(found)) if accepted(row, root))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; one narrow pass over whole pages."""
    root = tree()

    def run(batches):
        for b in batches:
            text = [main_text(h.as_py(), root) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
