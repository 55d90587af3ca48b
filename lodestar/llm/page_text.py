"""Main text of web pages: flat text blocks and a trained decision tree.

A page is cut at block-level tags into flat blocks.  Each block has its words,
its link density, the same of its two neighbours, whether it lies in the page's
main element, whether it and the next are paragraphs that end as sentences do, and
whether its element says that it is no article.  What a class or an identifier hints
at (menu, footer, advert, comments and so on) is weighed by the share of the page's
words inside: a wrapper of the whole page is no menu.  A main element lifts the
hints around it.  A decision tree, grown here from the small labelled table below by
Gini impurity, decides which blocks are text of the article.

Edge cases: null or empty html gives an empty text.  Unclosed and stray tags are
taken as browsers take them: a tag that never opened is ignored, one that never
closes ends with its parent.  Rows are read one by one, in whole; repeated rows
and null ids pass through; other columns, whatever their names, are not read.
"""
from __future__ import annotations

import html as _html
import re
from collections import defaultdict, namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

# Tag names and container words.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "iframe", "textarea")           # up to their end tag, as browsers read them
SILENT = frozenset("noscript template svg object canvas math".split())
FOREIGN, INSIDE = frozenset(["svg", "math"]), frozenset(["foreignobject", "title", "desc", "annotation-xml"])
CHROME = frozenset("nav footer aside button select menu dialog head title fieldset label".split())
MAIN = frozenset(["article", "main"])
HINT = re.compile(r"""(?i)(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|comments?|commentlist|reply|replies|
disqus|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?|alert|
newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|popup|modal|overlay|
toolbar|pagination|pager|search|skip|copyright|disclaimer|legal)(?:$|[\s_-])""".replace("\n", ""))
MAIN_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:main|articlebody|entry-content|post-content|post-body|article-body|story-body)(?:$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PROSE = frozenset("p blockquote pre dd".split())
SENTENCE = re.compile(r"[.!?…:;][\"'”’»)\]]*$")

# The labelled table.  Columns: words, percent of words in links, the same two of
# the block before and of the block after, in the main element, page has a main
# element, element says it is no article, percent of the page's words inside the
# smallest container with a hint (100 without one) where the hint opens the name and
# where it stands within, paragraph that ends as a sentence, the next one does, label.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "has_main", "chrome",
            "named", "hinted", "prose", "prose_after")


def _label(words, links, words_before, links_before, words_after, links_after, in_main, has_main, chrome, named, hinted,
           prose, prose_after) -> int:
    """What a reader says of a block: containers decide first, those with a hint where
    they hold little of the page; in a main element only lists of links go; on a page
    without one, text needs words, a sentence or a neighbour that is text."""
    if chrome or has_main and not in_main or named < (20 if in_main else 50) or hinted < (10 if in_main else 30):
        return 0
    listed = links > 60
    if in_main:
        return int(not (listed and (links_before > 60 or links_after > 60)))
    by_text = (words_before >= 15 and links_before < 30) or (words_after >= 15 and links_after < 30)
    return int(links < 30 and (words >= 12 or prose or (words >= 2 and (by_text or prose_after))))


def labelled() -> list[tuple]:
    """The labelled table, over a small grid of block shapes."""
    near = ((0, 0), (3, 0), (5, 100), (40, 0))
    places = [(*p, 100, 100, *q) for p in ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1))
              for q in ((0, 0), (0, 1), (1, 0), (1, 1))]
    places += [(*p, 0, n, 100, q, q) for p, shares in (((0, 0), (5, 40, 60)), ((1, 1), (5, 15, 25))) for n in shares for q in (0, 1)]
    places += [(*p, 0, 100, n, q, q) for p, shares in (((0, 0), (5, 20, 40)), ((1, 1), (5, 15))) for n in shares for q in (0, 1)]
    return [(*row, _label(*row)) for words in (1, 2, 6, 14, 60) for links in (0, 20, 50, 100) for before in near for after in near
            for place in places if (row := (words, links, *before, *after, *place))]


def grow(rows, depth: int = 20):
    """A decision tree: a label, or (feature, threshold, tree at or below, tree above)."""
    return _grow(np.array(rows, np.int64), depth)


def _grow(rows: np.ndarray, depth: int):
    ones = int(rows[:, -1].sum())
    if ones in (0, len(rows)) or depth == 0:
        return int(2 * ones >= len(rows))

    def gini(n, k):
        return 2 * k * (1 - k / n)

    best = None
    for f in reversed(range(rows.shape[1] - 1)):
        values = np.unique(rows[:, f]).tolist()
        for a, b in zip(values, values[1:]):
            t = (a + b) / 2
            low = rows[:, f] <= t
            n, k = int(low.sum()), int(rows[low, -1].sum())
            score = gini(n, k) + gini(len(rows) - n, ones - k)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, t, low)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, t, low = best
    return f, t, _grow(rows[low], depth - 1), _grow(rows[~low], depth - 1)


def decide(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _element(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool, bool, bool]:
    """(opens the main text, says that it is no article, has a hint that opens a name, has another hint, lifts all hints)."""
    main, chrome, named, hinted = tag in MAIN, tag in CHROME or (tag == "header" and not in_main), tag == "form", False
    lifts = tag == "main"
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name in ("class", "id"):
                if tag not in ("body", "html") and HINT.search(value):
                    for word in value.split():
                        for hint in HINT.finditer(word):
                            named = named or not hint.start()
                            hinted = hinted or "widget" not in hint.group().lower()
                main = main or bool(MAIN_HINT.search(value))
            elif name == "role":
                role = value.lower()
                chrome, main, named, lifts = chrome or role in ROLES, main or role == "main", named or role == "form", lifts or role == "main"
            elif name == "itemprop":
                lifts = lifts or value.lower() == "articlebody"
                main = main or lifts
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                chrome = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                chrome = True
    return main, chrome and not (main and tag in MAIN), named, hinted and not named and not main, lifts


Block = namedtuple("Block", "text words linked main chrome named hinted prose")
#: An open element; named and hinted: numbers of the containers with a hint that it lies in.
Open = namedtuple("Open", "tag main chrome link silent named hinted")


def blocks(page: str) -> list[Block]:
    """The blocks of a page."""
    out: list[Block] = []
    stack = [Open("", False, False, False, False, (), ())]
    parts: list[tuple[str, bool]] = []

    def flush():
        if parts:
            top = stack[-1]
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                words = text.count(" ") + 1
                linked = min(words, sum(len(t.split()) for t, a in parts if a))
                near = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
                out.append(Block(text, words, linked, top.main, top.chrome, top.named, top.hinted,
                                 near in PROSE and bool(SENTENCE.search(text))))
            parts.clear()

    at = opened = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1].silent:
            parts.append((_html.unescape(page[at:m.start()]), stack[-1].link))
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        tag = name.lower()
        if stack[-1].silent and tag in BLOCK and tag not in INSIDE and not m.group(2):    # blocks end a drawing that was left open
            i = max((i for i, e in enumerate(stack) if e.tag in FOREIGN), default=0)
            if i and not any(e.tag in INSIDE for e in stack[i:]):
                del stack[i:]
        if tag == "br":
            parts.append((" ", False))
            continue
        if m.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK and not stack[i].silent:
                        flush()
                    del stack[i:]
                    break
            else:
                if tag in BLOCK and not stack[-1].silent:
                    flush()
            continue
        if tag in BLOCK and not stack[-1].silent:
            flush()
        if tag not in VOID and not m.group(4).endswith("/"):
            if tag in ("p", "li", "a") and stack[-1].tag == tag:       # these end where the next one begins
                stack.pop()
            up = stack[-1]
            main, chrome, is_named, is_hinted, lifts = _element(tag, m.group(4), up.main)
            opened += 1
            named = (() if lifts else up.named) + ((opened,) if is_named and not lifts else ())
            hinted = (() if main else up.hinted) + ((opened,) if is_hinted else ())
            stack.append(Open(tag, up.main or main, up.chrome or chrome, up.link or tag == "a", up.silent or tag in SILENT, named, hinted))
    if at < len(page) and not stack[-1].silent:
        parts.append((_html.unescape(page[at:]), stack[-1].link))
    flush()
    return out


def features(found: list[Block]) -> list[tuple]:
    has_main = int(any(b.main and not b.chrome for b in found))
    size = [(b.words, 100 * b.linked // b.words) for b in found]
    inside, total = defaultdict(int), 0
    for b in found:
        if not b.chrome:
            total += b.words
            for i in {*b.named, *b.hinted}:
                inside[i] += b.words
    share = lambda ids: min((100 * inside[i] // max(1, total) for i in ids), default=100)
    edge, prose = (0, 0), [int(b.prose) for b in found] + [0]
    return [(*size[i], *(size[i - 1] if i else edge), *(size[i + 1] if i + 1 < len(size) else edge),
             int(b.main), has_main, int(b.chrome), share(b.named), share(b.hinted), prose[i], prose[i + 1]) for i, b in enumerate(found)]


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found)) if decide(tree, row))


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default page_id, url), ``text`` and ``n_chars``."""
    tree = grow(labelled())

    def run(column):
        texts = [main_text(p, tree) if p else "" for p in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return add_columns(pages, html_col, ["page_id", "url"] if keep is None else keep, run, "text string, n_chars long")
