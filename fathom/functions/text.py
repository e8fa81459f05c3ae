"""Text analysis in Spark expressions: words, stop words, phrases, windows, BM25 parts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = r"[^\p{L}\p{N}_]+"
#: Kana, Han characters and Hangul.
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
#: A short list a language, applied only where it is asked for.
STOP_WORDS = {
    "en": "a an and are as at be but by for from if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist ja mit nach nicht noch nur oder sich sie sind so um und von vor was wie wir zu zum zur".split(),
    "es": "al con de del el en es esta la las lo los más mi no o para pero por que se sin su sus te tu un una y ya".split(),
}


def may_hold(text: Column, terms: list[str]) -> Column:
    """A cheap test that every text with all of these words, or beginnings of words, passes, and few others do."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [low.contains(w) for w in dict.fromkeys(terms)])


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


def tokens(text: Column, stop_words: list[str] | None = None, cjk: bool = False) -> Column:
    """The text's lower-cased words in order, as an array; null for null.

    With cjk, each run of Chinese, Japanese or Korean characters gives its characters and
    pairs of them, in order, in place of a word.
    """
    out = F.array_remove(F.split(F.regexp_replace(F.lower(text), f"([{CJK}]+)", " $1 ") if cjk else F.lower(text), BREAK), "")
    if cjk:
        grams = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.when(i < F.length(w), F.array(F.substring(w, i, F.lit(1)), F.substring(w, i, F.lit(2)))).otherwise(F.array(F.substring(w, i, F.lit(1))))))
        out = F.flatten(F.transform(out, lambda w: F.when(w.rlike(f"^[{CJK}]"), grams(w)).otherwise(F.array(w))))
    if stop_words:
        out = F.filter(out, lambda w: ~w.isin(stop_words))
    return out


def cjk_words(w: str) -> list[str]:
    """The tokens that tokens() makes of a query's word with cjk: pairs of characters, or the only one."""
    out = []
    for run in re.findall(f"[{CJK}]+|[^{CJK}]+", w):
        out += [run] if not re.match(f"[{CJK}]", run) or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def read_stop_words(path: str) -> list[str]:
    """A stop list of a file: one word a line, comments after "|" or "#"."""
    with open(path, encoding="utf-8") as f:
        found = [re.split(r"[|#]", x)[0].split() for x in f]
    return [w[0].lower() for w in found if w]


def has_phrase(toks: Column, phrase: list[str]) -> Column:
    """The words next to one another, in order."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")


def _places(toks: Column, terms: list[str]) -> Column:
    """Where the terms stand, in order, as structs (i, w)."""
    need = F.array(*[F.lit(w) for w in dict.fromkeys(terms)])
    return F.array_compact(F.transform(toks, lambda w, i: F.when(F.array_contains(need, w), F.struct(i.alias("i"), w.alias("w")))))


def _some_window(toks: Column, terms: list[str], window: int, test) -> Column:
    """Whether test(places) holds for the places within `window` positions of some place.

    A window holds `window` places at most, so the work is in proportion to the text. Lambda
    variables bind the tokens and the places, which are then made once a row.
    """

    def within(places: Column) -> Column:
        near = lambda x, k: F.filter(F.slice(places, k + 1, F.lit(window)), lambda y: y["i"] < x["i"] + window)
        return F.exists(F.transform(places, near), test)

    return F.exists(F.array(_places(toks, terms)), within)


def has_near(toks: Column, near: list[str], window: int) -> Column:
    """All of the words within `window` positions, in any order."""
    many = len(set(near))
    return _some_window(toks, near, window, lambda places: F.size(F.array_distinct(F.transform(places, lambda x: x["w"]))) == many)


def has_ordered(toks: Column, terms: list[str], window: int) -> Column:
    """All of the words in this order within `window` positions."""
    wanted = F.array(*[F.lit(w) for w in terms])
    step = lambda k, x: F.when(F.get(wanted, k) == x["w"], k + 1).otherwise(k)
    return _some_window(toks, terms, window, lambda places: F.aggregate(places, F.lit(0), step) == len(terms))


def term_count(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda w: w == term))


def glob(pattern: str) -> str:
    """A glob with * and ? as a whole-string regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
