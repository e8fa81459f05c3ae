"""Main-text extraction from HTML with boosted trees over DOM nodes.

A tolerant parser makes a tree of block elements whose leaves are runs of inline text. Each
node has features: its tag, tokens of its class, id and role, its depth and place, density
of its subtree (text, links, tags, punctuation, form controls), statistics of its siblings
and what its ancestors say. Gradient-boosted trees estimate whether the node holds main
text. Decoding then finds the likeliest labelling of the tree in which no node is kept
below a dropped one; the kept text runs, in page order, are the text.

Null or empty html gives an empty text. Html without any tag is plain text and stays whole.
Cut-off html is read up to its end; an unfinished tag, comment or script is dropped.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted
from .common import lean, small_batches

_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "title", "textarea", "iframe")}
_NAME_END = re.compile(r"[\s/>]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+))>")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center dialog search hgroup menu legend select option button label".split())
VOID = frozenset("br img input meta link hr area base col embed source track wbr param".split())
_CLOSES_P = BLOCKS - {"option", "select", "button", "label", "legend", "summary"}
_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
_PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th")}

#: What tokens of class, id and role tell, by kind.
TOKENS = {
    "content": "article content post entry story body text main prose copy paragraph page blog news single detail read richtext markdown".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs crumbs pagination pager tabs toolbar links sitemap toc skip".split(),
    "header": "header masthead banner top logo brand branding topbar hero site".split(),
    "footer": "footer foot bottom copyright colophon contentinfo legal credits".split(),
    "side": "sidebar side aside rail widget widgets complementary related recommended more popular trending secondary teaser also recirc".split(),
    "advert": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted dfp adslot partner commercial".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay toast announcement privacy disclaimer paywall warning message".split(),
    "comment": "comment comments reply replies discussion disqus respond thread commentlist feedback reader responses".split(),
    "form": "form search login signup subscribe newsletter subscription signin register input contact poll survey".split(),
    "social": "share sharing social tweet facebook follow tags meta byline author bio date timestamp rating".split(),
}
_KIND = {w: k for k, words in enumerate(TOKENS.values()) for w in words}
KINDS = len(TOKENS)
NODES = 20_000
_TAGS = ["#text", "html", "body", "main", "article", "section", "div", "p", "h", "ul", "li", "dl", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "control", "other"]
_TAG_CODE = {t: k for k, t in enumerate(_TAGS)} | {f"h{i}": 8 for i in range(1, 7)} | {"ol": 9, "menu": 9, "dt": 10, "dd": 10, "tr": 17, "thead": 17, "tbody": 17, "tfoot": 17, "th": 18, "caption": 17, "figcaption": 21, "address": 14, "fieldset": 16, "search": 16, "select": 22, "option": 22, "button": 22, "label": 22, "legend": 22, "dialog": 15, "center": 6, "hgroup": 13}
_OTHER = _TAG_CODE["other"]


class Scanner:
    """The tags, comments and raw elements of a page: (begin, end, closing, name, attributes).

    name is None where there is nothing but something to leave out. A tag ends at the first
    ">" outside quotes; one that has none, or whose quotes don't close, is left out up to the
    next ">" or the end, or is text if another "<" comes first. Every character is looked at
    a bounded number of times: what was found ahead, or not found, is remembered.
    """

    def __init__(self, html: str):
        self.html = html
        self.ahead: dict[str, tuple[int, int]] = {}  # needle -> searched from, found at
        self.marks: list[int] | None = None  # places of quotes and ">", once a tag has failed
        self.bad: set[int] = set()  # quotes from which no tag ends

    def find(self, needle: str, at: int) -> int:
        """html.find for places that never go back; its length if there is none."""
        begin, found = self.ahead.get(needle, (0, -1))
        if not begin <= at <= found:
            found = self.html.find(needle, at)
            found = len(self.html) if found < 0 else found
            self.ahead[needle] = at, found
        return found

    def search(self, pattern: re.Pattern, at: int) -> int:
        """The place of a pattern's next match, as find()."""
        begin, found = self.ahead.get(pattern.pattern, (0, -1))
        if not begin <= at <= found:
            m = pattern.search(self.html, at)
            found = m.start() if m else len(self.html)
            self.ahead[pattern.pattern] = at, found
        return found

    def end_of_tag(self, at: int) -> int:
        """The place of the ">" that ends the tag whose attributes begin here; -1 if none does."""
        html = self.html
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[\"'>]", html)]
            self.next: list[int] = [len(self.marks)] * len(self.marks)  # the same mark's next place in marks
            last: dict[str, int] = {}
            for k in range(len(self.marks) - 1, -1, -1):
                c = html[self.marks[k]]
                self.next[k] = last.get(c, len(self.marks))
                last[c] = k
        k = bisect_left(self.marks, at)
        path = []
        while k < len(self.marks) and k not in self.bad:
            if html[self.marks[k]] == ">":
                return self.marks[k]
            path.append(k)
            k = self.next[k] + 1
        self.bad.update(path)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        html, at, n = self.html, 0, len(self.html)
        while True:
            at = html.find("<", at)
            if at < 0:
                return
            if html.startswith("<!--", at):
                end = min(n, self.find("-->", at + 4) + 3)
                yield at, end, False, None, ""
                at = end
                continue
            c = html[at + 1 : at + 2]
            if c == "!" or c == "?":
                end = min(n, self.find(">", at) + 1)
                yield at, end, False, None, ""
                at = end
                continue
            if not (c.isascii() and c.isalpha() or c == "/"):
                at += 1
                continue
            m = _TAG.match(html, at) if self.marks is None else None
            if m:
                end, closing, name, attrs = m.end(), bool(m.group(1)), m.group(2).lower(), m.group(3)
            else:
                k = at + 2 if c == "/" else at + 1
                first = html[k : k + 1]
                if not (first.isascii() and first.isalpha()):
                    if c == "/":  # "</" and no name: left out up to ">"
                        end = min(n, self.find(">", at) + 1)
                        yield at, end, False, None, ""
                        at = end
                    else:
                        at += 1
                    continue
                stop = self.search(_NAME_END, k)
                close = self.end_of_tag(stop)
                if close < 0:
                    other = self.find("<", at + 1)
                    end = min(n, self.find(">", at) + 1)
                    if other < end and c != "/":
                        at += 1
                        continue
                    yield at, end, False, None, ""
                    at = end
                    continue
                end, closing, name, attrs = close + 1, c == "/", html[k:stop].lower(), html[stop:close]
            if name in _RAW and not closing:
                end = self.search(_RAW[name], self.find(">", at))
                end = min(n, self.find(">", end) + 1)
                yield at, end, False, None, ""
            else:
                yield at, end, closing, name, attrs
            at = end


class Page:
    """A page's nodes in document order, as lists; node 0 is the root."""

    def __init__(self, html: str):
        self.parent, self.tag, self.kinds, self.depth, self.sums, self.text = [-1], [1], [None], [0], [[0.0] * 8], [None]
        self.hidden = [False]
        if "<" not in html:
            self.plain = " ".join(unescape(html).split())
            return
        self.plain = None
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node that each stands in
        places: dict[str, list[int]] = {"#root": [0]}  # where in the stack each name is
        blocks = [0]  # where block elements are
        run: list[str] = []  # pieces of the current text run
        linked = 0  # characters of the run within links
        anchors = 0
        tags = 0
        at = 0

        def flush() -> None:
            nonlocal run, linked, tags
            text = " ".join("".join(run).split())
            if text:
                node = self._new(stack[-1][1], 0, None)
                words = text.count(" ") + 1
                self.sums[node] = [len(text), min(linked, len(text)), words, 1.0, tags, sum(map(text.count, ".!?")), text.count(","), 0.0]
                self.text[node] = text
            run, linked, tags = [], 0, 0

        def cut(size: int) -> None:
            """Closes the elements from that place of the stack on."""
            while len(stack) > size:
                places[stack.pop()[0]].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()

        def nearest(names: tuple[str, ...]) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        def push(name: str, node: int) -> None:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, node))

        for a, b, closing, name, attrs in Scanner(html):
            if a > at:
                piece = unescape(html[at:a])
                run.append(piece)
                if anchors:
                    linked += len(piece.strip())
            at = b
            if name is None:
                continue
            if closing:
                if name == "a":
                    anchors = max(0, anchors - 1)
                if not places.get(name):
                    if name == "p" or name == "br":
                        flush() if name == "p" else run.append(" ")
                    continue
                place = places[name][-1]
                if name in BLOCKS:
                    flush()
                    anchors = 0
                    cut(place)
                elif place > blocks[-1]:
                    cut(place)
                continue
            if name in BLOCKS:
                flush()
                if name in _CLOSES_P and stack[blocks[-1]][0] == "p":
                    cut(blocks[-1])
                if name in _SELF:
                    place = nearest(_PEERS[name])
                    if place > nearest(_SELF[name]):
                        cut(place)
                if name in VOID:
                    continue
                if name == "html" or name == "body":
                    if places.get(name):
                        continue
                    cut(blocks[-1] + 1)
                node = self._new(stack[-1][1], _TAG_CODE.get(name, _OTHER), attrs)
                if name in ("button", "select", "option", "label"):
                    self.sums[node][7] += 1
                blocks.append(len(stack))
                push(name, node)
                anchors = 0
            else:
                tags += 1
                if name == "a":
                    anchors = 1
                elif name == "br":
                    run.append(" ")
                elif name == "input":
                    self.sums[stack[-1][1]][7] += 1
                if name not in VOID and not attrs.endswith("/"):
                    push(name, stack[-1][1])
        if at < len(html):
            run.append(unescape(html[at:]))
        flush()

    def _new(self, parent: int, tag: int, attrs: str | None) -> int:
        kinds, hidden = None, False
        if attrs and len(attrs) > 4:
            for m in _ATTR.finditer(attrs):
                for w in _WORD.findall(m.group(1) or m.group(2) or m.group(3) or ""):
                    k = _KIND.get(w.lower())
                    if k is not None:
                        kinds = kinds or [0] * KINDS
                        kinds[k] += 1
            hidden = _HIDDEN.search(attrs) is not None
        self.parent.append(parent)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.depth.append(self.depth[parent] + 1)
        self.sums.append([0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])
        self.text.append(None)
        self.hidden.append(hidden)
        return len(self.parent) - 1


def features(page: Page) -> np.ndarray:
    """(nodes, features); see the module's text."""
    n = len(page.parent)
    parent = np.array(page.parent)
    up = np.maximum(parent, 0)
    tag = np.array(page.tag)
    sums = np.array(page.sums)
    kinds = np.array([k or [0] * KINDS for k in page.kinds], float)
    own_kinds = np.minimum(kinds, 2)
    heads = (tag == 8).astype(float)
    paragraphs = (tag == 7).astype(float)
    total = np.column_stack([sums, heads, paragraphs, np.ones(n)])
    above = np.zeros((n, KINDS + 8))  # kinds and tags of proper ancestors, with the distance of the nearest
    marks = np.column_stack([own_kinds > 0, tag == 12, tag == 13, tag == 14, tag == 15, tag == 16, tag == 4, tag == 3, np.array(page.hidden)]).astype(float)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    for i in range(1, n):
        np.maximum(marks[parent[i]], above[parent[i]], out=above[i])
    size = np.bincount(up[1:], minlength=n).astype(float)
    order = np.zeros(n)
    count: dict[int, int] = {}
    for i in range(1, n):
        p = page.parent[i]
        order[i] = count.get(p, 0)
        count[p] = count.get(p, 0) + 1
    chars, links, words, runs, tags, ends, commas, controls, n_heads, n_par, n_nodes = total.T
    before = np.concatenate([[0], np.cumsum(sums[:, 0])[:-1]])
    whole = max(1.0, chars[0])
    safe = np.maximum(chars, 1)
    sib = np.maximum(size[up], 1)
    sib_chars = (chars[up] - chars) / np.maximum(sib - 1, 1)
    sib_links = (links[up] - links) / np.maximum(chars[up] - chars, 1)
    same = np.zeros(n)
    pairs: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        pairs[page.parent[i], page.tag[i]] = pairs.get((page.parent[i], page.tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = pairs[page.parent[i], page.tag[i]]
    cols = [
        tag, tag[up], tag[up[up]], np.array(page.depth), order, order / sib, size[up], size, same / sib,
        np.log1p(chars), np.log1p(words), chars / whole, before / whole, links / safe, links[up] / np.maximum(chars[up], 1), tags / safe * 100, n_nodes / safe * 100,
        ends / np.maximum(words, 1), commas / np.maximum(words, 1), words / np.maximum(runs, 1), runs, controls, controls[up], n_heads, n_par, n_par[up],
        np.log1p(sib_chars), sib_links, np.log1p(chars[up]), chars / np.maximum(chars[up], 1), n_heads[up], np.full(n, np.log1p(whole)), np.array(page.hidden),
    ]
    return np.column_stack([*cols, own_kinds, np.maximum(above, marks)])


def decode(parent: list[int], margin: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a kept node's parent is kept. The root always is."""
    keep = -np.logaddexp(0, -margin)
    drop = -np.logaddexp(0, margin)
    n = len(parent)
    none, best = drop.copy(), keep.copy()  # of whole subtrees, dropped or with the node kept
    for i in range(n - 1, 0, -1):
        p = parent[i]
        none[p] += none[i]
        best[p] += max(none[i], best[i])
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and best[i] > none[i]
    return out


def extract(htmls: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; some NODES nodes are judged at a time."""
    out, todo, nodes = [], [], 0

    def judge() -> None:
        nonlocal todo, nodes
        margin = model.margin(np.concatenate([features(p) for _, p in todo]))
        at = 0
        for k, p in todo:
            kept = decode(p.parent, margin[at : at + len(p.parent)])
            at += len(p.parent)
            out[k] = " ".join(t for t, y in zip(p.text, kept, strict=True) if t and y)
        todo, nodes = [], 0

    for k, h in enumerate(htmls):
        page = Page(h or "")
        out.append(page.plain or "")
        if page.plain is None and len(page.parent) > 1:
            todo.append((k, page))
            nodes += len(page.parent)
            if nodes >= NODES:
                judge()
    if todo:
        judge()
    return out


@lru_cache(maxsize=1)
def shipped_model() -> Boosted:
    """The model that train_html.py made."""
    with open(os.path.join(os.path.dirname(__file__), "html_model.json")) as f:
        return Boosted.from_dict(json.load(f))


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages(page_id, url, html)."""
    model = model or shipped_model()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
