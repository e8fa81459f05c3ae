"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct k-word shingles. Each of the sketch's registers is
K = clip(floor(1 - log_b E), 0, q + 1), where E is the least of one exponential variate per
shingle: an exponentially spaced, truncated minimum. Registers merge by max, and two sets
agree in a register with a probability close to their Jaccard similarity.

1. One pass over the texts makes (size, 128-bit fingerprint, sketch) a document.
2. Documents with one fingerprint are one class; its least doc_id stands for it.
3. Representatives meet in buckets of one band of registers. Every bucket links its members
   to a hub first, so that a group of k near copies costs k pairs and not k * k / 2. Members
   that no found link connects meet each other directly in buckets of up to FEW of them;
   those of larger buckets meet where they have one of their first shared shingles in
   common, which every link has (see _first_shared). No bucket is joined with itself.
4. The joint likelihood of the registers that are equal, greater and less estimates each
   pair's similarity; pairs many standard errors below the threshold go.
5. What is left is confirmed on the full shingle sets, and links become components.

Nulls and texts without a word have an empty set, which links with nothing. Rows that repeat
a doc_id are taken as one document per row in the sketch pass and share one component, since
components are named by doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lean, saved, small_batches

REGISTERS, ROWS = 96, 4  # 24 bands; a pair at 0.8 meets in none of them once in 3e5
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
FEW = 32  # members of a bucket that all meet
LONGS = 16  # of 64 bins each; see parities()
_BITS = [f"b{k}" for k in range(LONGS)]
CHUNK = 1 << 14  # shingles hashed at a time, so that the work stays in cache
PIECE = 1 << 17  # bytes of text hashed at a time

_rng = np.random.default_rng(20240917)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_BREAK = re.compile(rb"[\t-\r ]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted (uint64). Whole texts; A-Z lower-cased."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, to, blobs = 0, at, []
        while to < len(texts) and (to == at or size < PIECE):
            blob = (texts[to] or "").encode("utf-8", "surrogatepass").lower()
            blobs.append(blob)
            size += len(blob) + 1
            to += 1
        out += _sets_of(blobs, words)
        at = to
    return out


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it begins. PIECE bytes are held at a time, or one word."""
    hashes, begins, at = [], [], 0
    while at < len(text):
        found = _BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = found.end() if found else len(text)
        data = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]  # word i is data[first[i]:last[i]]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_BYTES[data], _power(_STEP, len(data))[: len(data)], out=sums[1:])
        np.cumsum(sums, out=sums)
        hashes.append(_mix((sums[last] - sums[first]) * _power(_BACK, len(data))[first] + (last - first).astype(np.uint64)))
        begins.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def _sets_of(blobs: list[bytes], words: int) -> list[np.ndarray]:
    ends = np.cumsum([len(b) + 1 for b in blobs])
    with np.errstate(over="ignore"):
        word, first = _words(b" ".join(blobs) + b" ")
        of = np.searchsorted(first, np.concatenate([[0], ends]))  # words of document d are of[d]:of[d + 1]
        mul = [np.uint64(pow(int(_STEP), i + 1, 2**64)) for i in range(words)]
        n = max(0, len(word) - words + 1)
        whole = np.zeros(n, np.uint64)
        for i in range(words):
            whole += word[i : i + n] * mul[i]
        whole = _mix(whole)
        out = []
        for a, b in zip(of[:-1], of[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(whole[a : b - words + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for i in range(b - a):
                    short = short + word[a + i] * mul[i]
                out.append(_mix(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), REGISTERS) uint16; the row of an empty set is all 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= CHUNK):
            size += len(sets[to])
            to += 1
        full = [i for i in range(at, to) if len(sets[i])]
        if full:
            x = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
            least = np.empty((len(full), REGISTERS), np.uint64)
            y = np.empty_like(x)
            for k in range(REGISTERS):
                np.multiply(x, _MUL[k], out=y)
                np.add(y, _ADD[k], out=y)
                least[:, k] = np.minimum.reduceat(y, starts)
            out[full] = registers(least)
        at = to
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Registers from the least of each row's uniform 64-bit hashes."""
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def joint_estimate(n_a, n_b, greater, less) -> np.ndarray:
    """The Jaccard similarity that best explains how many registers are greater and less.

    Maximises D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(1 - p(u - vJ) - p(v - uJ)) with
    p(x) = -log_b(1 - x (b - 1) / b), which is concave in J, by ternary search.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - greater - less

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def gain(j):
        more, fewer = p(u - v * j), p(v - u * j)
        return greater * np.log(more) + less * np.log(fewer) + equal * np.log(np.clip(1 - more - fewer, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = gain(a) < gain(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def _sketch_pass(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), words)
                rows = sketches(sets)
                prints = np.zeros((len(sets), 2), np.uint64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if len(s):
                            prints[i] = _mix(s).sum(), _mix(s ^ _STEP).sum() + np.uint64(len(s))
                prints = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)], pa.binary())],
                    schema=schema,
                )

    return run, "doc_id long, n long, f1 long, f2 long, sketch binary"


def _set_pass(words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), words)]
                to = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                bits = parities(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))), *[pa.array(bits[:, k]) for k in range(LONGS)]], names=["id", "set", *_BITS]
                )

    return run, f"id long, set array<long>, {', '.join(f'{b} long' for b in _BITS)}"


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), LONGS) int64: how many shingles fall into each of 64 * LONGS bins, modulo 2.

    The bins in which two sets differ are no more than the shingles that one of them has alone.
    """
    out = np.zeros((len(sets), LONGS), np.int64)
    for k, s in enumerate(sets):
        odd = np.bincount((s.view(np.uint64) * _STEP >> np.uint64(64 - 6 - LONGS.bit_length() + 1)).astype(np.int64), minlength=64 * LONGS) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


@lean
def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds est to (a, b, na, nb, sa, sb) and drops the sketches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        est = joint_estimate(batch.column(2).to_numpy(), batch.column(3).to_numpy(), (sa > sb).sum(1), (sa < sb).sum(1))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1)), pa.array(est)], names=["a", "b", "est"])


def _sizes_fit(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def _first_shared(loose: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, c, m, at, s, and parities): the shingles by which documents of different components may be linked.

    A link of a document of n shingles takes percent * n / 100 common ones at least, all of
    which another component holds, too. Of m such shingles in an order that all documents
    share, one of the first m - percent * n / 100 + 1 must then be common. Rare ones come
    first, so that what a whole template's pages hold is not among them.
    """
    items = loose.join(sets, "id").where(F.size("set") == F.col("n")).select("id", "n", "c", F.explode("set").alias("s"))
    shared = items.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo != hi").select("s", "df")
    ordered = items.join(shared, "s").groupBy("id", "n", "c").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    slots = F.size("x") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    bits = sets.select("id", F.size("set").alias("n"), *_BITS)
    placed = ordered.where(slots > 0).join(bits, ["id", "n"])
    return placed.select("id", "n", "c", F.size("x").alias("m"), *_BITS, F.posexplode(F.slice("x", F.lit(1), slots)).alias("at", "x")).select("id", "n", "c", "m", *_BITS, "at", "x.s")


def _across(first: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components and fitting sizes that have a first shingle in common.

    Per shingle, only members of other components than the largest one are held against all,
    so a component of k near copies costs k pairs for each document beside it, not k * k. Two
    documents aren't paired by their first common shingle where either has too few after it,
    or where their parities differ in more bins than they may have shingles of their own.
    """
    lead = first.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("lead"))
    placed = first.join(lead, "s")
    # "at" counts from 0: of the m shingles in their common order, m - at begin at this one.
    x, y = (placed.select(*[F.col(c).alias(f"{c}{k}") for c in ("s", "lead", "id", "n", "c", "m", "at", *_BITS)]) for k in "xy")
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in _BITS])
    enough = (100 + percent) * F.least(F.col("mx") - F.col("atx"), F.col("my") - F.col("aty")) >= percent * (F.col("nx") + F.col("ny"))
    enough = enough & ((100 + percent) * apart <= (100 - percent) * (F.col("nx") + F.col("ny")))
    once = (F.col("cy") == F.col("leady")) | (F.col("idx") > F.col("idy"))
    pairs = x.where("cx != leadx").join(y, (F.col("sx") == F.col("sy")) & (F.col("cx") != F.col("cy")) & once & _sizes_fit("nx", "ny", percent) & enough)
    return pairs.select(F.greatest("idx", "idy").alias("a"), F.least("idx", "idy").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    words-word shingles; component_id is the least doc_id reachable, kept says whether that
    is the document's own. Extra columns of docs are ignored. A null doc_id keeps a null
    component and is kept.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = saved(texts.mapInArrow(*_sketch_pass(words)), "sketch")
    known = sketch.where("n > 0 and doc_id is not null")
    least = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    reps = saved(least, "reps")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(REGISTERS // ROWS)])
    rows = reps.select("id", "n", F.explode(bands).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("hub")).where("k > 1").select("key", "hub")
    members = saved(rows.join(shared, "key").select("key", "id", "n", "hub"), "members")
    need = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")  # alike at every size
    sets = saved(texts.join(need, "doc_id", "left_semi").mapInArrow(*_set_pass(words)).dropDuplicates(["id", "set"]), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    light = reps.select("id", "n", "sketch")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links: likely by their sketches, true on their sets."""
        from_a = light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        from_b = light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        both = pairs.join(from_a, "a").join(from_b, "b").where(_sizes_fit("na", "nb", percent))
        likely = both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimate, "a long, b long, est double")
        slack = 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
        likely = likely.where(F.col("est") >= percent / 100 - slack).select("a", "b")
        met = likely.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("inter"))
        return saved(met.where(F.col("inter") * 100 >= percent * (F.col("total") - F.col("inter"))).select("a", "b").distinct(), "links")

    spokes = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = confirm(spokes)
    part = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "part")

    named = members.join(part.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "hub", F.coalesce("component", "id").alias("c"))
    open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    loose = saved(named.where("id != hub").join(open_keys, "key", "left_semi").select("key", "id", "n", "c"), "loose")
    k = loose.groupBy("key").agg(F.count("*").alias("k"))
    few = loose.join(k.where(F.col("k") <= FEW).select("key"), "key")
    many = loose.join(k.where(F.col("k") > FEW).select("key"), "key", "left_semi").select("id", "n", "c").distinct()
    x, y = (few.select(*[F.col(c).alias(f"{c}{s}") for c in ("key", "id", "n", "c")]) for s in "xy")
    rest = x.join(y, (F.col("keyx") == F.col("keyy")) & (F.col("idx") > F.col("idy")) & (F.col("cx") != F.col("cy")) & _sizes_fit("nx", "ny", percent)).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
    first = saved(_first_shared(many, sets, percent), "first")
    rest = rest.union(_across(first, percent)).distinct()
    more = confirm(rest)
    if not more.isEmpty():
        joined = part.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        part = saved(components(joined), "part")
    discard(members, sets, loose, first, links, more)
    classes = reps.join(part.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component_id"))
    out = sketch.join(classes, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

