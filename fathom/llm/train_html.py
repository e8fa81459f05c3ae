"""Makes html_model.json: boosted trees fitted to pages that this module invents.

Pages mix many layouts: semantic tags, classed divs, tables and bare divs, with or without
each kind of boilerplate, in several places. Run: python -m fathom.llm.train_html
"""

from __future__ import annotations

import json
import os
import random

import numpy as np

from .boost import Boosted, fit
from .html import TOKENS, Page, features

YES, NO = "\ue000", "\ue001"  # begin each text run that is, or is not, main text
PAGES = 4000


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        syllables = [a + b for a in "b c d f g h l m n p r s t v th sh qu ch".split() for b in "a e i o u ai ou er in on é ü".split()]
        self.words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(400)]
        self.glue = r.choice([" "] * 6 + [" | ", "!! ", "*** ", " "])  # between the words of prose
        self.sep = r.choice(["", "", "\n", "\n  "])
        self.junk = r.choice([None] * 7 + [["%%%", "***", "$$$", "###", "&amp;&amp;&amp;", ""]])  # after each word of prose

    def phrase(self, a: int, b: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(a, b)))

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.phrase(1, 3) if self.r.random() < 0.2 else self.phrase(4, 22)
            s = s.replace(" ", self.glue)
            if self.junk:
                s = " ".join(w + self.r.choice(self.junk) for w in s.split(" "))
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s.capitalize() + self.r.choice("...!?"))
        return " ".join(out)

    def attrs(self, kind: str | None, chance: float = 0.8) -> str:
        r = self.r
        if kind is None or r.random() > chance:
            return r.choice(["", "", f' class="{r.choice(["c", "css-", "x", "row ", "col-", "wrap", "inner", "box", "block", "container", "layout-"])}{r.randint(1, 99)}"'])
        token = r.choice(TOKENS[kind])
        style = r.choice(["{}", "{}-{}", "{}_{}", "site-{}", "{}-wrapper", "{}-box clearfix", "l-{}", "js-{}", "{}Area", "page-{}"])
        return f' {r.choice(["class", "class", "class", "id", "role"])}="{style.format(token, r.choice(["1", "inner", "item", "block", "main", "area"]))}"'

    def el(self, tag: str, inner: str, kind: str | None = None, chance: float = 0.8) -> str:
        return f"<{tag}{self.attrs(kind, chance)}>{self.sep}{inner}{self.sep}</{tag}>{self.sep}"

    def links(self, n: int, mark: str = NO, tag: str = "ul") -> str:
        r = self.r
        items = [f'<a href="/{i}">{mark}{self.phrase(1, 4)}</a>' for i in range(n)]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{i}</li>" if r.random() < 0.95 else f"<li>{i}" for i in items) + "</ul>"
        return r.choice([" | ", " ", " / "]).join(items)

    def boiler(self, kind: str) -> str:
        r = self.r
        tags = {"menu": ["nav", "div", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "div", "section"], "comment": ["section", "div", "ol"], "form": ["form", "form", "div"]}.get(kind, ["div", "div", "aside", "section", "p"])
        tag = r.choice(tags)
        if kind == "menu":
            return self.el(tag if tag != "ul" else "div", self.links(r.randint(2, 12), tag=r.choice(["ul", "ul", "flat"])), kind)
        if kind == "header":
            return self.el(tag, r.choice(["", f"<h{r.randint(1, 3)}>{NO}{self.phrase(1, 5)}</h2>", f'<a href="/">{NO}{self.phrase(1, 3)}</a>']) + r.choice(["", self.links(r.randint(2, 8)), f"<p>{NO}{self.phrase(2, 8)}</p>"]), kind)
        if kind == "footer":
            return self.el(tag, r.choice(["", self.links(r.randint(2, 9), tag=r.choice(["ul", "flat"]))]) + r.choice([f"{NO}&copy; {r.randint(1999, 2025)} {self.phrase(1, 4)} &middot; {self.prose(1)}", f"<p>{NO}&copy; {self.prose(1)}</p>", f"<div>{NO}{self.prose(r.randint(1, 2))}</div>"]), kind)
        if kind == "side":
            return self.el(tag, "".join(self.el("div", f"<h{r.randint(2, 4)}>{NO}{self.phrase(1, 3)}</h3>" + r.choice([self.links(r.randint(2, 8)), f"<p>{NO}{self.prose(r.randint(1, 3))}</p>"]), None) for _ in range(r.randint(1, 3))), kind)
        if kind == "comment":
            items = "".join(self.el("li" if tag == "ol" else r.choice(["div", "article", "div"]), r.choice([f"<b>{NO}{self.phrase(1, 2)}</b>", f"<p>{NO}{self.phrase(1, 3)}</p>", f"<h4>{NO}{self.phrase(1, 2)}</h4>", ""]) + f"<p>{NO}{self.prose(r.randint(1, 5))}</p>" + r.choice(["", '<a href="#">' + NO + "Reply</a>"]), r.choice(["comment", None])) for _ in range(r.randint(1, 6)))
            return self.el(tag, r.choice(["", f"<h3>{NO}{self.phrase(1, 3)}</h3>"]) * (tag != "ol") + items + r.choice(["", "", self.boiler("form")]), kind, 0.95)
        if kind == "form":
            return self.el(tag, r.choice(["", f"<label>{NO}{self.phrase(1, 3)}</label>", f"<p>{NO}{self.prose(1)}</p>", f"<h3>{NO}{self.phrase(2, 5)}</h3>"]) + '<input name="q">' * r.randint(1, 4) + r.choice([f"<button>{NO}{self.phrase(1, 2)}</button>", '<input type="submit">', f"<select><option>{NO}{self.phrase(1, 2)}<option>{NO}{self.phrase(1, 2)}</select>"]), kind)
        if kind == "advert":
            return self.el(tag, r.choice([f"{NO}{self.prose(r.randint(1, 3))}", f"{NO}{self.phrase(2, 10)}", f'<a href="http://x">{NO}{self.phrase(2, 8)}</a>', f"<p>{NO}{self.prose(r.randint(1, 3))}</p>", f"<h4>{NO}{self.phrase(1, 4)}</h4><p>{NO}{self.prose(1)}</p>"]), kind, 0.95)
        if kind == "notice":
            return self.el(tag, r.choice([f"<p>{NO}{self.prose(r.randint(1, 4))}</p>", f"{NO}{self.prose(r.randint(1, 3))}"]) + r.choice(["", f"<button>{NO}{self.phrase(1, 2)}</button>", f'<a href="/p">{NO}{self.phrase(1, 3)}</a>']), kind, 0.95)
        return self.el(r.choice(["div", "ul", "p"]), self.links(r.randint(2, 6), tag="flat") if r.random() < 0.5 else f"{NO}{self.phrase(1, 5)}", kind)

    def inline(self, text: str) -> str:
        r = self.r
        words = text.split(" ")
        for _ in range(r.randint(0, 2) if len(words) > 3 else 0):
            i = r.randrange(len(words))
            words[i] = r.choice(["<b>{}</b>", '<a href="/w">{}</a>', "<em>{}</em>", "{}<br>", "<span>{}</span>", "<b>{}"]).format(words[i])
        return " ".join(words)

    def article(self) -> str:
        r = self.r
        size = r.choice([1, 1, 2, 3, 5, 8, 12, 20, 30])
        long = r.choice([1, 2, 4, 7])
        bare = r.random() < 0.15  # text in divs or divided by <br>
        parts = []
        if r.random() < 0.85:
            parts.append(f"<h1>{YES}{self.phrase(2, 9)}</h1>")
        for k in range(size):
            x = r.random()
            if x < 0.72:
                tag = "div" if bare else "p"
                parts.append(f"<{tag}>{YES}{self.inline(self.prose(r.randint(1, long)) if r.random() > 0.12 else self.phrase(1, 4).capitalize().replace(' ', self.glue) + self.r.choice(['.', '.', '', '?']))}" + ("" if tag == "p" and r.random() < 0.25 else f"</{tag}>"))
            elif x < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{YES}{self.phrase(1, 6)}</h3>" + f"<p>{YES}{self.prose(r.randint(1, long))}</p>")
            elif x < 0.87:
                parts.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{YES}{self.phrase(2, 14)}</li>" for _ in range(r.randint(2, 6)))))
            elif x < 0.91:
                parts.append(f"<blockquote>{r.choice(['', '<p>'])}{YES}{self.prose(r.randint(1, 3))}</blockquote>")
            elif x < 0.94:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{YES}{self.phrase(1, 4)}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif x < 0.96:
                parts.append(f"<pre>{YES}{self.phrase(3, 20)}</pre>")
            else:
                parts.append(f'<figure><img src="x.png"><figcaption>{YES}{self.phrase(3, 12)}</figcaption></figure>')
            if r.random() < 0.06:
                parts.append(self.boiler(r.choice(["advert", "side", "social", "form", "notice"])))
        return self.sep.join(parts)

    def page(self) -> str:
        r = self.r
        body = self.article()
        style = r.random()
        if style < 0.4:
            body = self.el("article", body, r.choice(["content", None]), 0.5)
        elif style < 0.55:
            body = self.el("main", body, r.choice(["content", None]), 0.5)
        elif style < 0.85:
            body = self.el(r.choice(["div", "div", "section", "td"]), body, "content", 0.9)
        else:
            body = self.el(r.choice(["div", "section", "td"]), body, None)
        pick = lambda p, options: "".join(self.boiler(k) for k in options if r.random() < p)
        dense = r.choice([0.15, 0.4, 0.7])
        if r.random() < 0.3:
            body = self.el(r.choice(["main", "div", "section", "article"]), body + pick(dense * 0.6, ["social", "comment", "side", "form"]), r.choice(["content", None]))
        top = pick(dense, r.sample(["menu", "header", "notice", "advert", "form"], 5))
        end = pick(dense, r.sample(["comment", "side", "advert", "menu", "footer", "notice", "form", "social"], 8))
        if "<td" in body[:4]:
            body = f"<table><tr>{r.choice(['', '<td>' + self.links(5) + '</td>'])}{body}</tr></table>"
        if r.random() < 0.3:
            body = self.el("div", pick(dense, ["menu", "side"]) + body + pick(dense, ["side", "advert"]), r.choice([None, "content"]), 0.6)
        if r.random() < 0.75 and "<footer" not in end:
            end += self.boiler("footer")
        html = top + body + end
        for _ in range(r.randint(0, 2)):
            html = self.el("div", html, None)
        html = f"<!DOCTYPE html><html><head><title>{self.phrase(2, 6)}</title></head><body>{html}</body></html>"
        return html[: int(len(html) * r.uniform(0.6, 1))] if r.random() < 0.08 else html


def labelled(html: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (holds main text) and weights of a marked page's nodes."""
    page = Page(html)
    y = np.zeros(len(page.parent))
    for i, t in enumerate(page.text):
        if t:
            y[i] = YES in t
            page.text[i] = t.replace(YES, "").replace(NO, "")
            page.sums[i][0] = max(1, page.sums[i][0] - t.count(YES) - t.count(NO))
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return features(page), y, 1 + np.log1p([s[0] for s in page.sums]) / 4


def train(pages: int = PAGES, seed: int = 3) -> Boosted:
    parts = [labelled(Maker(seed * 100_003 + k).page()) for k in range(pages)]
    x, y, w = (np.concatenate(p) for p in zip(*parts, strict=True))
    return fit(x, y, w)


if __name__ == "__main__":
    model = train()
    with open(os.path.join(os.path.dirname(__file__), "html_model.json"), "w") as f:
        json.dump(model.to_dict(), f, separators=(",", ":"))
