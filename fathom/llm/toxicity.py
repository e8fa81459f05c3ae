"""Toxicity scoring of texts whose toxic words may be disguised.

A noisy channel is assumed: somebody wrote a word, then replaced letters by look-alikes
(leetspeak), put separators or spaces between letters, or repeated letters. Each suspicious
span becomes a lattice of what its characters may have been, and Viterbi decoding finds the
most likely original under a character 4-gram model counted over every document. A logistic
model over the restored words, fitted to labels, gives the score.

Null and empty texts hold no words and get the score of the model's intercept. Texts are
read whole. Rows that repeat a doc_id are scored each by its own text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, saved, small_batches

ORDER, LETTERS = 4, 28  # 0 is a word's edge, 1-26 are a-z, 27 any other letter
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SWAP, DROP, SPLIT, REPEAT = math.log(0.2), math.log(0.3), math.log(0.1), math.log(0.08)
#: Labelled rows that the classifier is fitted on, at most; those of the least hashed ids.
SAMPLE = 16_000
#: Half the likelihood ratio that a feature must reach: beyond it words are noise.
SIGNIFICANT = 6.0
#: Features kept, labelled rows that must hold one, and the lengths of word beginnings that
#: are features beside whole words (so that a stem counts whatever its ending).
WORDS, SUPPORT, STEMS = 2_000, 5, (4, 5, 6)
CACHE, LONG = 60_000, 64  # tokens whose words a worker keeps, and the longest of these

_CODE = np.full(256, 27, np.int32)
_CODE[:128] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_PLAIN = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)\1")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_UNREAD = "".join(re.escape(c) for c in LEET if not c.isalnum())
#: Symbols at a word's edges that LEET cannot read.
_ASCII_UNREAD = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in LEET)
_TRIM = re.compile(rf"^(?:(?![{_UNREAD}])[\W_])+|(?:(?![{_UNREAD}])[\W_])+$")


@lean
def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's character 4-grams: gram, n."""
    total = np.zeros(LETTERS**ORDER, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            data = " ".join(t for t in batch.slice(at, 200).column(0).to_pylist() if t)
            data = np.frombuffer(f"   {data}   ".encode("utf-8", "surrogatepass"), np.uint8)
            for k in range(0, len(data), 1 << 17):
                c = _CODE[data[k : k + (1 << 17) + ORDER - 1]]
                if len(c) >= ORDER:
                    g = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
                    got = np.bincount(g)
                    total[: len(got)] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def char_model(texts: DataFrame) -> np.ndarray:
    """log P(d | a b c) as a (LETTERS ** 4) array, counted over every row of texts(text).

    The counts meet in one row a gram, at most LETTERS ** 4 (614,656) rows however long the
    corpus is.
    """
    small_batches(texts.sparkSession)
    grams = texts.select("text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow()
    n = np.zeros(LETTERS**ORDER)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return smoothed(n.reshape((LETTERS,) * ORDER))


def smoothed(n: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Each order's counts fall back on the next lower order's."""
    p = np.full(LETTERS, 1 / LETTERS)
    for k in range(1, ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - k)))
        p = (c + weight * p) / (c.sum(-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32).ravel()


def _letter(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


@lru_cache(maxsize=4096)
def _readings(ch: str) -> tuple[tuple[tuple[str, int, float], ...], bool, bool]:
    """The letters that a character may stand for (letter, code, cost), whether it may end a word, and be nothing."""
    found = [(ch, _letter(ch), 0.0)] if ch.isalpha() else []
    found += [(x, _letter(x), SWAP) for x in LEET.get(ch, "")]
    apart = not ch.isalnum()
    return tuple(found), apart, apart or not found


def decode(span: str, lm: list[float]) -> list[str]:
    """The likeliest words behind a lower-cased span, spaces allowed within.

    Full Viterbi: a state is the last three codes and the last letter, of which the readings
    of nearby characters allow few (28 ** 3 codes at most, whatever the span's length). A
    path is a chain of its letters, so that a long span costs time and memory in proportion.
    """
    states: dict[tuple[int, str], tuple[float, tuple | None]] = {(0, ""): (0.0, None)}
    size = LETTERS**3
    for ch in span:
        letters, apart, nothing = _readings(ch)
        nxt: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        get = nxt.get
        for state, (score, chain) in states.items():
            past, source = state
            at = past * LETTERS
            for x, code, cost in letters:
                total = score + cost + lm[at + code]
                key = (at + code) % size, x
                had = get(key)
                if had is None or total > had[0]:
                    nxt[key] = total, (chain, x)
                if x == source:  # a repeated letter
                    total = score + cost + REPEAT
                    had = get(state)
                    if had is None or total > had[0]:
                        nxt[state] = total, chain
            if nothing:
                total = score + DROP
                had = get(state)
                if had is None or total > had[0]:
                    nxt[state] = total, chain
            if apart:
                total = score + SPLIT + lm[at]
                key = at % size, ""
                had = get(key)
                if had is None or total > had[0]:
                    nxt[key] = total, (chain, " ")
        states = nxt
    chain = max(states.items(), key=lambda s: s[1][0] + lm[s[0][0] * LETTERS])[1][1]
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out)).split()


def undoubled(word: str, at: int, lm: list[float]) -> str:
    """What decode() makes of a word of letters of which only that at `at` repeats the one before.

    Only the four-grams from there on differ between the word and the word without it.
    """
    codes = [0, 0, 0, *map(_letter, word[max(0, at - 3) : at + 4])][-(min(at, 3) + len(word[at : at + 4]) + 3) :]
    here = 3 + min(at, 3)  # of word[at] in codes
    if at + 4 > len(word):
        codes.append(0)
    less = codes[:here] + codes[here + 1 :]

    def total(c: list[int], begin: int, end: int) -> float:
        return sum(lm[((c[i - 3] * LETTERS + c[i - 2]) * LETTERS + c[i - 1]) * LETTERS + c[i]] for i in range(begin, end))

    if REPEAT + total(less, here, len(less)) > total(codes, here, len(codes)):
        return word[:at] + word[at + 1 :]
    return word


def restore(token: str, lm: list[float]) -> tuple[str, ...]:
    """The words a lower-cased token may stand for: itself without its edges, and decoded.

    Symbols at the edges that may be letters are decoded with it; others are trimmed.
    """
    if token.isalpha():
        core = trimmed = token
        plain = True
    else:
        core, trimmed = _EDGE.sub("", token), _TRIM.sub("", token)
        plain = _PLAIN.fullmatch(core) is not None
    out = [core] if plain else []
    double = _DOUBLE.search(core) if plain else None
    if double and core.isalpha() and not _DOUBLE.search(core, double.start() + 1):
        out.append(undoubled(core, double.start() + 1, lm))
    elif core and (double or not plain):
        out += decode(core, lm)
    if trimmed != core:
        out += decode(trimmed, lm)
    return tuple(dict.fromkeys(w for w in out if len(w) >= 3))


def bare(token: str) -> str:
    """The token, or what restore() makes the same of: the letters between unreadable ASCII symbols."""
    inner = token.strip(_ASCII_UNREAD)
    return inner if inner.isalpha() else token


def features(word: str) -> tuple[str, ...]:
    """The word, marked by a dot, and its beginnings."""
    return (word + ".", *(word[:k] for k in STEMS if len(word) >= k))


def spaced(words: list[str]) -> list[str]:
    """Runs of at least three words of one character, as spans with spaces.

    A character with symbols before it begins a run, and one with symbols after it ends one.
    """
    out, run = [], []

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            out.append(" ".join(run))
        run = []

    last = -1
    for at, w in [(at, w) for at, w in enumerate(words) if len(w) == 1 or not w[:2].isalnum()]:  # others hold two characters
        if at != last + 1:
            end()
        last = at
        if len(w) == 1:
            run.append(w)
            continue
        core = _TRIM.sub("", w)
        core = core if len(core) == 1 else _EDGE.sub("", w)
        if len(core) != 1:
            end()
            continue
        if w[0] != core:
            end()
        run.append(core)
        if w[-1] != core:
            end()
    end()
    return out


class Restorer:
    """Restored distinct words of texts; keeps what it has decoded, up to CACHE tokens."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm.tolist(), {}

    def words(self, text: str | None) -> set[str]:
        tokens = (text or "").lower().split()
        known, out = self.known, set()
        for t in set(map(bare, set(tokens))):
            got = known.get(t)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = restore(t, self.lm)
                if len(t) <= LONG:
                    known[t] = got
            out.update(got)
        for span in spaced(tokens):
            out.update(w for w in decode(span, self.lm) if len(w) >= 3)
        return out


def fit(rows: list[tuple[int, list[int]]], n_words: int, penalty: float = 0.2, steps: int = 1000) -> tuple[float, np.ndarray]:
    """Logistic regression on word presence: intercept and weights, by accelerated gradient."""
    y = np.array([r[0] for r in rows], float)
    if not len(y):
        return -3.0, np.zeros(n_words)
    p = min(max(y.mean(), 0.5 / len(y)), 1 - 0.5 / len(y))
    b, w = math.log(p / (1 - p)), np.zeros(n_words)
    doc = np.repeat(np.arange(len(y)), [len(r[1]) for r in rows])
    word = np.array([k for r in rows for k in r[1]], int)

    def margins(b: float, w: np.ndarray) -> np.ndarray:
        return b + np.bincount(doc, w[word], len(y))

    c, v, most = 1.0, np.ones(n_words), 1.0  # the greatest curvature, by power iteration
    for _ in range(20):
        z = margins(c, v)
        c, v = z.sum(), np.bincount(word, z[doc], n_words)
        most = math.hypot(c, float(np.linalg.norm(v)))
        c, v = c / most, v / most
    rate = 1 / (0.25 * 1.1 * most + penalty)
    vb, vw, t = b, w, 0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(margins(vb, vw), -35, 35))) - y
        gb, gw = g.sum(), np.bincount(word, g[doc], n_words) + penalty * vw
        nb, nw = vb - rate * gb, vw - rate * gw
        t = 0 if gb * (nb - b) + gw @ (nw - w) > 0 else t + 1  # momentum starts anew where it climbs
        k = t / (t + 3)
        vb, vw, b, w = nb + k * (nb - b), nw + k * (nw - w), nb, nw
    return b, w


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, sample: int = SAMPLE, seed: int = 7) -> tuple[float, dict[str, float]]:
    """Intercept and word weights, from labels(doc_id, toxic) of rows that aren't held out.

    Held out are rows with crc32(doc_id as text) mod 5 = 0. At most `sample` labelled rows
    are used, of the least seeded hashes. Without labels every word weighs 0.
    """
    spark = docs.sparkSession
    used = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "toxic")
        .limit(sample)
    )
    model = spark.sparkContext.broadcast(lm)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(restorer.words(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=["toxic", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(texts.join(F.broadcast(used), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, words array<string>"), "restored")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        discard(rows)
        return math.log((bad + 0.5) / (n - bad + 0.5)) if n else -3.0, {}
    stems = [F.expr(f"transform(filter(words, w -> length(w) >= {k}), w -> substring(w, 1, {k}))") for k in STEMS]
    seen = rows.select("toxic", F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(w, F.lit("."))), *stems)).alias("words"))
    counts = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("x"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    x, y, p = F.col("x"), F.col("n") - F.col("x"), bad / n
    term = lambda k, q: F.when(k > 0, k * F.log(k / (F.col("n") * q))).otherwise(0.0)
    chosen = [r.word for r in counts.withColumn("g", term(x, p) + term(y, 1 - p)).where(F.col("g") >= SIGNIFICANT).orderBy(F.col("g").desc(), "word").limit(WORDS).collect()]
    place = {w: k for k, w in enumerate(chosen)}
    only = seen.select("toxic", F.array_intersect("words", F.array(*[F.lit(w) for w in chosen])).alias("words"))
    got = [(r.toxic, [place[w] for w in r.words]) for r in only.collect()]
    discard(rows)
    b, w = fit(got, len(chosen))
    return b, {x: float(w[k]) for x, k in place.items() if abs(w[k]) > 1e-4}


def score(docs: DataFrame, lm: np.ndarray, intercept: float, weights: dict[str, float], name: str = "score") -> DataFrame:
    """docs(text, and any other columns) with the column `name`, each row's score."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((lm, weights))
    names = docs.columns
    text_at = names.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weigh = model.value
        table = table.tolist()
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for value in batch.column(text_at):
                tokens = (value.as_py() or "").lower().split()
                hit: set[str] = set()
                for t in set(map(bare, set(tokens))):
                    got = known.get(t)
                    if got is None:
                        if len(known) >= CACHE:
                            known.clear()
                        got = tuple(f for w in restore(t, table) for f in features(w) if f in weigh)
                        if len(t) <= LONG:
                            known[t] = got
                    if got:
                        hit.update(got)
                for span in spaced(tokens):
                    hit.update(f for w in decode(span, table) if len(w) >= 3 for f in features(w) if f in weigh)
                z = intercept + math.fsum(weigh[w] for w in hit)
                out.append(1 / (1 + math.exp(-min(max(z, -35.0), 35.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, dict[str, float]]:
    """The character model of all of docs, and the classifier: what score() takes."""
    lm = char_model(docs.select(F.col("text").cast("string").alias("text")))
    return (lm, *train(docs, labels, lm, sample))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) of every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(texts, *model(docs, labels, sample)).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
