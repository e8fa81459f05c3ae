"""Soundex codes for English, French, German and Spanish; codes aren't cut to a length."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of each code, and the letters that are read as others first.
_EN = {"bp": "1", "fv": "2", "cks": "3", "gj": "4", "qxz": "5", "dt": "6", "l": "7", "mn": "8", "r": "9", "aehiouwy": "0"}
_EN_FROM, _EN_TO = "".join(_EN), "".join(d * len(k) for k, d in _EN.items())
_DE = {"AEIJOUY": "0", "BP": "1", "DT": "2", "FVW": "3", "GKQ": "4", "L": "5", "MN": "6", "R": "7", "CSZ": "8"}
_ES = {"BPFV": "1", "CGKSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6", "QJ": "7", "AEHIOUWY": "0"}
_VOWELS = {**dict.fromkeys("ÁÀÄÂÃáàäâã", "A"), **dict.fromkeys("ÉÈËÊŒéèëêœ", "E"), **dict.fromkeys("ÍÌÏÎíìïî", "I"), **dict.fromkeys("ÓÒÖÔÕóòöôõ", "O"), **dict.fromkeys("ÚÙÜÛúùüû", "U"), **dict.fromkeys("Ññ", "N")}
_ACCENTS = {
    "fr": str.maketrans(_VOWELS | dict.fromkeys("Çç", "S")),
    "de": str.maketrans({"Ä": "A", "ä": "A", "Ö": "O", "ö": "O", "Ü": "U", "ü": "U", "ß": "S"}),
    "es": str.maketrans({k: v for k, v in _VOWELS.items() if k in "ÁÉÍÓÚÀÈÌÒÙÜÑáéíóúàèìòùüñ"}),
}
_FR_PAIRS = [("GUI", "KI"), ("GUE", "KE"), ("GA", "KA"), ("GO", "KO"), ("GU", "K"), ("CA", "KA"), ("CO", "KO"), ("CU", "KU"), ("Q", "K"), ("CC", "K"), ("CK", "K")]
_FR_STARTS = [("KN", "NN"), ("PF", "FF"), ("PH", "FF"), ("ASA", "AZA"), ("SCH", "SSS"), ("MAC", "MCC")]
_DE_PAIRS = [*((p, "8") for p in "DC DS DZ TC TS TZ KX QX SC ZC".split()), ("PH", "3"), *((p, "4") for p in "CA CH CK CO CQ CU CX".split())]
_ES_PAIRS = [("CH", "V"), ("QU", "K"), ("LL", "J"), ("CE", "S"), ("CI", "S"), *((f"Y{v}", "J") for v in "AEIOU"), ("GE", "J"), ("GI", "J"), ("NY", "N")]


def _upper(text: str, language: str) -> str:
    return "".join(c.upper() if "a" <= c <= "z" else c for c in text.translate(_ACCENTS[language]))


def _digits(text: str, table: dict[str, str], first: str = "", kept: str = "") -> str:
    digit = {c: d for letters, d in table.items() for c in letters}
    out = list(first)
    for c in text:
        if c in kept:
            out.append(c)
        elif c == "X" and kept:  # German: two sounds
            out += ["8"] if out and out[-1] == "4" else ["4", "8"]
        elif c in digit and (not out or out[-1] != digit[c]):
            out.append(digit[c])
    return "".join(out)


def french(text: str) -> str:
    s = re.sub("[^A-Z]", "", _upper(text, "fr"))
    for a, b in _FR_PAIRS:
        s = s.replace(a, b)
    s = s[:1] + re.sub("[EIOU]", "A", s[1:])
    for a, b in _FR_STARTS:
        if s.startswith(a):
            s = b + s[len(a) :]
            break
    for a, b in _FR_STARTS[:-1]:
        s = s[:1] + s[1:].replace(a, b)
    kept = ""
    for c in s:
        if not (c == "H" and kept[-1:] not in ("C", "S") or c == "Y" and kept[-1:] != "A"):
            kept += c
    if len(kept) > 1 and kept[-1] in "ATDS":
        kept = kept[:-1]
    return re.sub(r"(.)\1+", r"\1", kept)


def german(text: str) -> str:
    s = re.sub("^[^A-Z]+", "", _upper(text, "de"))
    if len(s) > 1 and s[0] == "C" and s[1] in "AHKLOQRUX":
        s = "4" + s[2:]
    for a, b in _DE_PAIRS:
        s = s.replace(a, b)
    return _digits(s, _DE, kept="348")


def spanish(text: str) -> str:
    s = re.sub("^[^A-GI-Z]+", "", _upper(text, "es"))
    if not s:
        return s
    second = s[1:2]
    first = {"V": "B", "Z": "S", "X": "S", "G": "J" if second and second in "EI" else "G", "C": "K" if second else "C"}.get(s[0], s[0])
    s = first + s[1:]
    for a, b in _ES_PAIRS:
        s = s.replace(a, b)
    return _digits(s, _ES, first=s[0])


def _english(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    codes = F.regexp_replace(F.translate(F.lower(letters), _EN_FROM, _EN_TO), r"(.)\1+", "$1")
    return F.concat(F.upper(F.substring(letters, 1, 1)), codes)


def _python(encode):
    @F.pandas_udf("string")
    def code(texts: pd.Series) -> pd.Series:
        known = {t: None if t is None else encode(t) for t in texts.unique()}
        return texts.map(known)

    return code


_ENCODERS = {"fr": french, "de": german, "es": spanish}


def soundex(text: Column, language: str = "en") -> Column:
    """The code of text in the language: en, fr, de or es."""
    if language == "en":
        return _english(text)
    return _python(_ENCODERS[language])(text)


def soundex_of_each(texts: Column, language: str = "en") -> Column:
    """The codes of an array of texts."""
    if language == "en":
        return F.transform(texts, _english)
    encode = _ENCODERS[language]

    @F.pandas_udf("array<string>")
    def codes(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if xs is None else [None if x is None else encode(x) for x in xs] for xs in arrays], dtype="object")

    return codes(texts)
