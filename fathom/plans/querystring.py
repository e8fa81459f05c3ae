"""The compact query language: field:value, ranges, AND OR NOT XOR MAYBE and parentheses.

parse() gives the same documents as the JSON language. NOT binds tightest, then AND, MAYBE,
XOR and OR; terms side by side are OR-ed. Text inside text fields has a language of its own:
parse_text() knows "phrases", a NEAR/n b, a ADJ/n b, +must, -mustn't, wild*, w?ld, part** and
fuzz~N.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LEX = re.compile(
    r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<sym>[&|!])|(?P<id>(?:[A-Za-z_][\w.]*:)?(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\[(][^\[\]()]*[\])]|[^\s()&|!"']+)))""",
)
_RANGE = re.compile(r"""^(?P<a>[\[(])\s*(?P<from>"[^"]*"|'[^']*'|[^,\]]*?)\s*,\s*(?P<to>"[^"]*"|'[^']*'|[^,\])]*?)\s*(?:,[^\])]*)?(?P<b>[\])])$""")
_WORDS = {"AND": "_and", "OR": "_or", "XOR": "_xor", "NOT": "_not", "MAYBE": "_and_maybe"}
_SYMBOLS = {"&": "_and", "|": "_or", "!": "_not"}
_LEVELS = ("_or", "_xor", "_and_maybe", "_and")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text): "(" and ")", "op" with the operator's name, or "id"."""
    out, at = [], 0
    while at < len(text) and text[at:].strip():
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the query at {text[at:]!r}")
        at = m.end()
        kind = m.lastgroup
        got = m[kind]
        if kind == "id" and got.upper() in _WORDS:
            out.append(("op", _WORDS[got.upper()]))
        elif kind == "sym":
            out.append(("op", _SYMBOLS[got]))
        elif kind == "open":
            end = re.match(r"\(([^()]*,[^()]*)[\])]", text[m.start("open") :])
            if end:  # an open range without a field
                at = m.start("open") + end.end()
                out.append(("id", end[0]))
            else:
                out.append(("(", "("))
        else:
            out.append(("id" if kind == "id" else ")", got))
    return out


def parse(text: str) -> object:
    """The JSON form of a query string."""
    if text.strip() in ("", "*"):
        return "*" if text.strip() else {"_match_none": True}
    toks = tokens(text)
    at = 0

    def peek() -> tuple[str, str] | None:
        return toks[at] if at < len(toks) else None

    def level(k: int) -> object:
        nonlocal at
        if k == len(_LEVELS):
            return unary()
        op, items = _LEVELS[k], [level(k + 1)]
        while (t := peek()) and (t == ("op", op) or op == "_or" and (t[0] in ("id", "(") or t == ("op", "_not"))):
            at += t == ("op", op)
            items.append(level(k + 1))
        return items[0] if len(items) == 1 else {op: items}

    def unary() -> object:
        nonlocal at
        t = peek()
        if t is None:
            raise ValueError(f"the query ends too soon: {text!r}")
        at += 1
        if t == ("op", "_not"):
            return {"_not": [unary()]}
        if t[0] == "(":
            inner = level(0)
            if peek() != (")", ")"):
                raise ValueError(f"')' is missing: {text!r}")
            at += 1
            return inner
        if t[0] != "id":
            raise ValueError(f"{t[1]!r} is out of place in {text!r}")
        return leaf(t[1])

    out = level(0)
    if at < len(toks):
        raise ValueError(f"{toks[at][1]!r} is out of place in {text!r}")
    return out


def unquote(text: str) -> str:
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def parse_range(text: str) -> dict | None:
    """{"_from", "_to", "_open"} of [a,b], (a,b], a..b, a.. or ..b; null if it is no range."""
    m = _RANGE.match(text)
    if m:
        a, b = unquote(m["from"]), unquote(m["to"])
        kind = m["a"] + m["b"]
    else:
        parts = text.split("..")
        if len(parts) < 2 or text[0] in "\"'":
            return None
        if len(parts) > 2:
            raise ValueError(f"a range has two ends: {text!r}")
        a, b, kind = unquote(parts[0]), unquote(parts[1]), "[]"
    out = {k: v for k, v in (("_from", a), ("_to", b)) if v != ""}
    if kind != "[]":
        out["_open"] = kind
    return out


def leaf(text: str) -> object:
    m = re.match(r"""([A-Za-z_][\w.]*):(.*)$""", text, re.DOTALL)
    name, value = (m[1], m[2]) if m else ("", text)
    bounds = parse_range(value) if value else None
    if bounds is not None:
        spec: object = {"_in": {"_range": bounds}}
    elif value[:1] in "\"'" and value:
        spec = value if value[0] == '"' else '"' + unquote(value) + '"'
    else:
        spec = value
    return {name: spec} if name else {"_value": spec}


@dataclass
class TextQuery:
    """Parts of a text query; each item is (kind, value): word, phrase, near, adj, wild, partial or fuzzy.

    A word that begins with a capital letter has True as its third part.
    """

    any: list[tuple] = field(default_factory=list)
    must: list[tuple] = field(default_factory=list)
    never: list[tuple] = field(default_factory=list)


_TEXT = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


def parse_text(text: str) -> TextQuery:
    from ..functions.text import words

    out = TextQuery()
    items = _TEXT.findall(text)
    k = 0
    while k < len(items):
        sign, quoted, bare = items[k]
        to = {"+": out.must, "-": out.never}.get(sign, out.any)
        near, k = _windowed(items, k, words)
        if near:
            to.append(near)
            continue
        if quoted:
            if ws := words(quoted):
                to.append(("phrase", ws) if len(ws) > 1 else ("word", ws[0]))
            continue
        fuzzy = re.fullmatch(r"(\w+)~(\d*)", bare)
        if fuzzy:
            to.append(("fuzzy", fuzzy[1].lower(), int(fuzzy[2] or 2)))
        elif bare.endswith("**"):
            to.append(("partial", bare[:-2].lower()))
        elif re.fullmatch(r"[\w*?]+", bare) and ("*" in bare or "?" in bare):
            to.append(("wild", bare.lower()))
        elif ws := words(bare):
            to.append(("phrase", ws) if len(ws) > 1 else ("word", ws[0], True) if bare[:1].isupper() else ("word", ws[0]))
    return out


def _windowed(items: list[tuple[str, str, str]], k: int, words) -> tuple[tuple | None, int]:
    """("near" or "adj", words, window) of "a NEAR/n b NEAR c" from item k on, and the item after it.

    n is 10 if it isn't given; the window is the greatest n and a place for each further word.
    """
    ws, most, kind, at = words(items[k][2]), 0, "", k
    while len(ws) and at + 2 < len(items):
        m = re.fullmatch(r"(NEAR|ADJ)(?:/(\d+))?", items[at + 1][2])
        after = words(items[at + 2][2]) if m and not items[at + 2][0] else []
        if not m or kind not in ("", m[1]) or len(after) != 1 or at == k and len(ws) != 1:
            break
        kind, most, at = m[1], max(most, int(m[2] or 10)), at + 2
        ws += after
    return ((kind.lower(), ws, most - 1 + len(ws)), at + 1) if kind else (None, k + 1)
