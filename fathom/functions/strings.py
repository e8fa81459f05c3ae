"""String distances in [0, 1]: 0 for equal strings, 1 if either is empty.

Levenshtein, Dice, Jaccard and English Soundex are Spark expressions. The others need a
matrix or matching window per pair and run as Arrow-batched functions, once for each
distinct value of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetic import soundex, soundex_of_each


def _based(a: Column, b: Column, distance: Column, icase: bool) -> Column:
    del icase
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.when(a == b, 0.0).otherwise(1.0)).when(a == b, 0.0).otherwise(distance)


def levenshtein(a: Column, b: Column, icase: bool = False) -> Column:
    """Edits over the longer length."""
    a, b = (F.upper(a), F.upper(b)) if icase else (a, b)
    return _based(a, b, F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), icase)


def _pairs_of(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2)))


def dice(a: Column, b: Column, icase: bool = False) -> Column:
    """1 - Dice over the sets of adjacent character pairs; 1 if a string is of one character."""
    a, b = (F.upper(a), F.upper(b)) if icase else (a, b)
    x, y = _pairs_of(a), _pairs_of(b)
    near = 1 - 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return _based(a, b, F.when((F.length(a) < 2) | (F.length(b) < 2), 1.0).otherwise(near), icase)


def jaccard(a: Column, b: Column, icase: bool = False) -> Column:
    """1 - Jaccard over the sets of characters."""
    a, b = (F.upper(a), F.upper(b)) if icase else (a, b)
    x, y = (F.array_remove(F.array_distinct(F.split(s, "")), "") for s in (a, b))
    return _based(a, b, 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), icase)


def jaro_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine, theirs = [], []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_similarity(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    near = jaro_similarity(a, b)
    if near <= boost:
        return near
    shared = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        shared += 1
    return near + shared * scale * (1 - near)


def _common(a: str, b: str, apart: bool) -> int:
    """Length of the longest common substring, or subsequence if apart."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            now = row[j]
            row[j] = before + 1 if x == y else (max(row[j], row[j - 1]) if apart else 0)
            before = now
            best = max(best, row[j])
    return best


def _ratio(a: str, b: str, apart: bool) -> float:
    return _common(a, b, apart) / max(len(a), len(b), 1)


def _python_one(similar: Callable[[str, str], float], icase: bool) -> Callable[[str | None, str | None], float | None]:
    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        a, b = (a.upper(), b.upper()) if icase else (a, b)
        if a == b:
            return 0.0
        return 1.0 - similar(a, b) if a and b else 1.0

    return one


def _python(similar: Callable[[str, str], float], icase: bool) -> Callable[[Column, Column], Column]:
    one = _python_one(similar, icase)

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            known = {p: one(*p) for p in {*zip(a, b, strict=True)}}
            yield pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")

    return distance


def _python_each(similar: Callable[[str, str], float], icase: bool) -> Callable[[Column, Column], Column]:
    """As _python, from arrays of strings to arrays of distances."""
    one = _python_one(similar, icase)

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            known: dict[tuple[str | None, str | None], float | None] = {}
            out = []
            for xs, y in zip(a, b, strict=True):
                for x in [] if xs is None else xs:
                    if (x, y) not in known:
                        known[x, y] = one(x, y)
                out.append(None if xs is None else [known[x, y] for x in xs])
            yield pd.Series(out, dtype="object")

    return distances


_NATIVE = {"levenshtein": levenshtein, "leven": levenshtein, "dice": dice, "sorensendice": dice, "sorensen": dice, "jaccard": jaccard}
_SIMILAR: dict[str, Callable[[str, str], float]] = {
    "jaro": jaro_similarity,
    "jarowinkler": jaro_winkler_similarity,
    "jarow": jaro_winkler_similarity,
    "lcs": lambda a, b: _ratio(a, b, False),
    "lcsubstr": lambda a, b: _ratio(a, b, False),
    "lcsq": lambda a, b: _ratio(a, b, True),
    "lcsubsequence": lambda a, b: _ratio(a, b, True),
}


def _plain_name(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "")


def metric(name: str, icase: bool = False, language: str = "en") -> Callable[[Column, Column], Column]:
    """The distance of that name: levenshtein, jaro, jarowinkler, dice, jaccard, lcs, lcsq, soundex."""
    name = _plain_name(name)
    if name in _NATIVE:
        return lambda a, b: _NATIVE[name](a, b, icase)
    if name in ("soundex", "sound"):
        return lambda a, b: _python(lambda x, y: _ratio(x, y, True), icase)(soundex(a, language), soundex(b, language))
    if name not in _SIMILAR:
        raise ValueError(f"unknown metric {name!r}")
    return _python(_SIMILAR[name], icase)


def metric_of_each(name: str, icase: bool = False, language: str = "en") -> Callable[[Column, Column], Column]:
    """As metric, from an array of strings and a string to the array of all distances."""
    name = _plain_name(name)
    if name in _NATIVE:
        return lambda a, b: F.transform(a, lambda x: _NATIVE[name](x, b, icase))
    if name in ("soundex", "sound"):
        return lambda a, b: _python_each(lambda x, y: _ratio(x, y, True), icase)(soundex_of_each(a, language), soundex(b, language))
    if name not in _SIMILAR:
        raise ValueError(f"unknown metric {name!r}")
    return _python_each(_SIMILAR[name], icase)
