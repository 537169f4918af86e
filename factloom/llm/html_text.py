"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<(?P<end>/?)[a-z][^>]*\Z"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's elements without content, those that part blocks, and what class, id and role say of a container.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = set("nav footer aside form button select dialog menu head search label option fieldset datalist".split())
BOILER_WORDS = set(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay comment comments reply replies disqus respond "
    "footer share sharing social related recommended recommendations newsletter subscribe signup login search widget toolbar pagination pager "
    "skip alert dialog masthead topbar".split()
)
#: Words that a container of main text may bear as well.
VAGUE_WORDS = set("side copyright legal disclaimer tags".split())
BOILER_ROLES = set("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
MAIN_WORDS = {"article", "post", "story", "entry"}
#: An element on the left is closed by the start of one on the right.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

#: inside_main: 2 inside the main container, 1: the page has none, 0: outside it; chrome: inside a tag or role of the page's frame, or hidden;
#: named: 2 inside a container of a BOILER_WORDS name, 1: of a VAGUE_WORDS name.
FEATURES = ["words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "inside_main", "chrome", "named", "heading"]


class _Element:
    __slots__ = ("chrome", "main", "named", "tag")

    def __init__(self, tag: str, up: _Element | None, attrs: str) -> None:
        self.tag = tag
        main, chrome, named = (up.main, up.chrome, up.named) if up else (False, False, 0)
        names, role, hidden = set(), "", False
        if attrs.strip(" /"):
            for k, a, b, c, flag in _ATTR.findall(attrs):
                k, v = (k or flag).lower(), a or b or c
                if k in ("class", "id"):
                    names |= {x.lower() for x in _PARTS.findall(v)}
                elif k == "role":
                    role = v.strip().lower()
                elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
                    hidden = True
        chrome = chrome or tag in BOILER_TAGS or role in BOILER_ROLES or hidden
        # a page's header; an article's own holds its title
        chrome = chrome or (not main and (tag == "header" or (tag in ("div", "section") and "header" in names)))
        if tag not in ("body", "html", "main") and not (tag == "article" and not main):
            named = max(named, 2 if names & BOILER_WORDS else 1 if names & VAGUE_WORDS else 0)
        if not chrome and named < 2 and (tag in MAIN_TAGS or role in MAIN_ROLES or (tag in ("div", "section") and names & MAIN_WORDS)):
            main = True
        self.main, self.chrome, self.named = main, chrome, named

    @property
    def framed(self) -> bool:
        return self.chrome or self.named > 0


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """Text blocks in page order and their features (FEATURES)."""
    if not page:
        return []
    stack: list[_Element] = []
    found: list[list] = []
    text: list[str] = []
    linked: list[str] = []
    anchors = 0
    any_main = False

    def flush():
        nonlocal any_main
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else None
                n, m = len(joined.split()), len(html.unescape("".join(linked)).split())
                heading = any(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in stack)
                main = bool(top and top.main)
                any_main |= main
                found.append([joined, n, min(1.0, m / n), main, bool(top and top.chrome), top.named if top else 0, heading])
            text.clear()
        linked.clear()

    def add(s):
        text.append(s)
        if anchors:
            linked.append(s)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() in ("textarea", "iframe", "object"):
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            anchors = 0 if m["close"] else 1
            continue
        if tag not in BLOCK:
            if tag == "img":
                continue
            if tag not in VOID and not m["close"] and not (m["attrs"] or "").endswith("/") and re.search(r"\b(class|id|role|hidden|style|aria-hidden)\b", m["attrs"] or "", re.I):
                e = _Element(tag, stack[-1] if stack else None, m["attrs"])
                if e.framed and not (stack and stack[-1].framed):
                    flush()  # an inline element that is hidden or an advert is a block of its own
                    stack.append(e)
            elif m["close"] and stack and stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        flush()
        if tag == "hr":
            continue
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    anchors = 0
                    break
                if stack[i].tag in ("td", "th", "li") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol", "article", "main", "section", "div", "body", "html", "nav", "footer", "aside", "form", "header"):
                    break
            continue
        while stack:
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in BLOCK:
                i -= 1
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                del stack[i:]
            else:
                break
        stack.append(_Element(tag, stack[-1] if stack else None, m["attrs"] or ""))
    if at < len(page):
        add(page[at:])
    flush()
    out = []
    for i, (s, n, density, main, chrome, named, heading) in enumerate(found):
        before = found[i - 1] if i else (None, 0, 0.0)
        after = found[i + 1] if i + 1 < len(found) else (None, 0, 0.0)
        out.append((s, [float(n), density, float(before[1]), before[2], float(after[1]), after[2], 2.0 if main else 0.0 if any_main else 1.0, float(chrome), float(named), float(heading)]))
    return out


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _a(n: int) -> str:
    return f'<a href="/x">{_w(n)}</a>'


#: The small labelled table: page layouts, and a 1 for each of their blocks that is main text, in page order.
#: Half of the pages are plain containers, in which only a block's and its neighbours' numbers tell.
LABELLED = [
    (f"<header><div>{_w(3)}</div><nav><ul><li>{_a(1)}<li>{_a(2)}</ul></nav></header><article><h1>{_w(7)}</h1><p>{_w(60)}<p>{_w(1)}<p>{_w(24)}<p>{_w(2)}</article><footer>{_w(6)}</footer>", "000111110"),
    (f"<nav>{_a(1)}</nav><div class=ad>{_w(9)}</div><main><h1>{_w(4)}</h1><p>{_w(1)}</p><p>{_w(2)} {_a(1)} {_w(40)}</p><div class=ad>{_w(30)}</div><p>{_w(12)}</p><ul><li>{_w(5)}<li>{_w(3)}</ul></main><aside>{_w(25)}</aside><footer>{_w(14)}</footer>", "00111011100"),
    (f"<article><h1>{_w(5)}</h1><p>{_w(80)}</p><p>{_a(2)} {_w(9)}</p><p>{_w(6)}</p><section class=comments><h3>{_w(1)}</h3><p>{_w(33)}</p><p>{_w(2)}</p></section></article><form><p>{_w(4)}</p></form>", "11110000"),
    (f"<article><p>{_w(1)} {_a(5)}</p><p>{_w(1)}</p><p>{_a(6)}</p><p>{_w(3)} {_a(2)}</p></article><div>{_a(3)}</div><div>{_w(9)}</div>", "111100"),
    (f"<div>{_w(3)}</div><main><article><header><h1>{_w(6)}</h1><p>{_w(3)}</p></header><p>{_w(48)}</p><p>{_a(4)}</p><p>{_w(35)}</p></article></main><div>{_w(28)}</div><div>{_w(2)}</div>", "01111100"),
    (f"<div>{_w(40)}</div><div class=post-legal><p>{_w(40)}</p><p>{_w(5)}</p></div><div class=legal>{_w(30)}</div>", "0110"),
    (f"<div id=cookie-notice>{_w(22)} {_a(2)}</div><div class=menu>{_a(1)}<p>{_a(2)}</div><div><h1>{_w(8)}</h1><p>{_w(55)}</p><p>{_w(4)}</p><p>{_w(45)}</p></div><div class=comments><p>{_w(40)}</p></div><div>{_a(2)}</div>", "000111100"),
    (f"<div class=banner>{_w(35)}</div><div><p>{_w(50)}</p><p>{_w(20)}</p></div><aside><p>{_w(30)}</p></aside><form>{_w(15)}</form><footer><p>{_w(25)}</p></footer>", "011000"),
    (f"<div>{_a(2)}</div><div>{_a(1)}</div><div>{_w(2)} {_a(3)}</div><div><p>{_w(70)}</p><p>{_w(18)} {_a(2)} {_w(15)}</p><p>{_w(11)}</p></div><div>{_a(4)}</div><div>{_a(3)}</div><div>{_w(3)}</div>", "000111000"),
    (f"<div>{_a(1)}</div><p>{_w(90)}</p><p>{_w(17)}</p><div>{_a(2)} {_w(1)}</div>", "0110"),
    (f"<div>{_a(1)}</div><div>{_a(1)}</div><div>{_w(4)}</div><div>{_a(2)}</div><h1>{_w(6)}</h1><p>{_w(33)}</p><p>{_w(3)}</p><p>{_w(28)}</p><p>{_w(7)}</p><p>{_w(64)}</p><div>{_a(1)}</div><div>{_a(3)}</div>", "000011111100"),
    (f"<div>{_a(3)}</div><div>{_a(2)}</div><div>{_w(14)}</div><div>{_w(41)}</div><div>{_w(2)}</div><div>{_w(22)} {_a(3)}</div><div>{_a(5)}</div><div>{_a(1)}</div><div>{_w(5)}</div>", "001111000"),
    (f"<div>{_w(2)}</div><div>{_a(2)}</div><div>{_a(2)}</div><h2>{_w(9)}</h2><div>{_w(120)}</div><div>{_w(30)}</div><div>{_a(8)}</div><div>{_w(4)} {_a(4)}</div><div>{_w(6)} {_a(1)}</div>", "000111000"),
    (f"<div>{_a(12)}</div><div>{_w(1)} {_a(15)}</div><p>{_w(25)}</p><p>{_w(36)} {_a(6)}</p><p>{_w(5)}</p><p>{_w(19)}</p><div>{_a(20)}</div><div>{_w(8)}</div>", "00111100"),
    (f"<div>{_a(1)}</div><h1>{_w(4)}</h1><p>{_w(13)}</p><p>{_w(16)}</p><p>{_w(1)}</p><p>{_w(10)}</p><div>{_a(2)}</div><div>{_a(1)} {_w(2)}</div>", "01111100"),
    (f"<div><h2>{_w(4)}</h2></div><p>{_w(26)}</p><p>{_w(2)}</p>", "111"),
    (f"<p>{_w(40)}</p>", "1"),
    (f"<article><h1>{_w(6)}</h1><nav>{_a(4)}</nav><p>{_w(45)}</p><div class=ad>{_a(7)}</div><p>{_w(2)}</p><aside><p>{_a(3)}</p></aside><p>{_a(5)}</p><div class=comments><p>{_a(2)}</p><p>{_w(21)}</p></div></article>", "101010100"),
    (f"<article><p>{_w(30)}</p><p>{_a(2)}</p><p>{_w(5)}</p><p>{_a(1)}</p><p>{_w(48)}</p><p>{_a(4)}</p><p>{_w(70)}</p><nav>{_a(6)}</nav><div class=share>{_a(3)}</div><p>{_a(3)}</p></article>", "1111111001"),
    (f"<main><div class=ad>{_a(3)}</div><p>{_a(2)}</p><p>{_w(4)}</p><p>{_w(2)}</p><p>{_a(3)}</p><p>{_w(60)}</p><nav>{_a(2)}</nav></main>", "0111110"),
    (f"<article><p>{_w(1)} {_a(5)}</p><p>{_w(1)}</p></article>", "11"),
    (f"<main><p>{_w(20)}</p><p>{_a(3)}</p><p>{_w(9)}</p></main>", "111"),
    (f"<div>{_w(50)}</div><article><form>{_a(2)}</form><p>{_w(3)}</p><p>{_w(8)}</p><div class=newsletter><p>{_w(11)}</p><p>{_a(2)}</p></div><p>{_w(31)}</p><footer><p>{_w(7)}</p><p>{_a(3)}</p></footer></article>", "001100100"),
    (f"<div>{_a(1)}</div><div>{_a(2)}</div><div>{_w(4)}</div><div>{_a(1)}</div><p>{_w(44)}</p><p>{_w(2)}</p><p>{_w(2)}</p><p>{_w(38)}</p><p>{_w(9)}</p><p>{_w(6)}</p><div>{_a(2)}</div><div>{_w(3)}</div>", "000011111100"),
    (f"<div>{_a(3)}</div><div>{_w(2)}</div><div>{_a(1)}</div><h1>{_w(12)}</h1><p>{_w(75)}</p><p>{_a(3)} {_w(30)}</p><div>{_a(2)} {_w(1)}</div><div>{_w(3)}</div><div>{_a(4)}</div>", "000111000"),
    (f"<div><p>{_w(35)}</p><p>{_w(50)}</p></div>", "11"),
    (f"<article><p>{_w(1)}</p></article><footer>{_w(1)}</footer>", "10"),
    (f"<h1>{_w(5)}</h1><p>{_w(50)}</p><p>{_w(12)}</p><p>{_w(8)}</p>", "1111"),
]


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    x, y = [], []
    for page, marks in LABELLED:
        found = blocks(page)
        if len(found) != len(marks):
            raise AssertionError(f"{len(found)} blocks, {len(marks)} labels: {page[:80]}")
        x += [f for _, f in found]
        y += [int(c) for c in marks]
    return np.array(x), np.array(y)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """CART by Gini impurity: nested (feature, threshold, tree if <=, tree if >), leaves 0 or 1.  Of equal splits, the first feature's."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, left = best
    return (f, t, fit_tree(x[left], y[left], depth - 1), fit_tree(x[~left], y[~left], depth - 1))


@cache
def tree():
    return fit_tree(*training_table())


def is_main(node, features: list[float]) -> bool:
    while not isinstance(node, int):
        f, t, low, high = node
        node = low if features[f] <= t else high
    return bool(node)


def main_text(page: str | None, node=None) -> str:
    """Blocks that the tree takes for main text, joined by two line feeds."""
    node = tree() if node is None else node
    return "\n\n".join(s for s, f in blocks(page) if is_main(node, f))


def _extract(keep: list[str]):
    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p.as_py(), node) for p in part["_html"]]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of pages (default: all but the html), text and n_chars (code points), one row per page.

    Null, empty and main-text-free pages have an empty text.  Malformed pages are read
    as far as their tags go (unclosed elements end with their container or the page).
    The whole of every page is read.  Columns of pages named text or n_chars are
    replaced.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string", "n_chars long"])
    return rows.mapInArrow(_extract(keep), schema)
