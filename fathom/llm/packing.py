"""Packing of tokenised documents into sequences of several context sizes.

Tiers are windows of 512, 1024, 2048 and 4096 tokens. A document of at least the largest
window gives whole windows first; what remains of it, and every shorter document, is routed
to the least tier that holds it. Each tier fills its open window with the longest waiting
pieces that fit; a gap that none of its own fits is filled from the shorter tiers, the
longest that fits first; and what gap is left takes a cut from the longest waiting piece, so
every emitted window is full. The end of a partition's stream is cut into windows of
descending powers of two. Thus no sequence holds padding.

Windows are dealt to steps of STEP_TOKENS tokens as they fill, tier by tier, so every full
step of any tier holds as many tokens as any other.

It is one narrow pass: each partition packs its own rows, in order, with a bounded buffer
of waiting pieces; sequence_id holds the partition's number in its upper bits. Null and
empty texts are one token, the end id. Rows that repeat a doc_id are packed each by itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

TIERS = (512, 1024, 2048, 4096)
END = 2
STEP_TOKENS = 8 * 4096
WAITING = 96  # pieces that a tier lets wait before it fills a window
CACHE = 400_000  # pieces whose ids a worker keeps
CHUNK = 1 << 20  # bytes of text that are encoded at a time; a longer text goes alone


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it is printable."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words in turn. A plain word, of ASCII and Latin-1 letters, digits and punctuation, is
    a row of pieces: runs of letters, single digits, runs of punctuation. What precedes the
    tokenizer's merges does nothing else to these than lower their case, so the distinct new
    ones of a batch go to the merges directly. Any other word, also one with an apostrophe
    before a letter or the beginning of a special token, is one piece that the whole
    tokenizer reads. Pieces are found by array operations over a batch's bytes and counted by
    Arrow's dictionary; Python sees each distinct piece of a batch once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for word, i in self.tokenizer.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # piece -> its place in first and count
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last."""
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if at[0] == at[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        pieces, whole, of = _pieces(data, at - at[0])
        codes = pieces.dictionary_encode()
        found, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        hard = np.zeros(len(found), bool)
        hard[codes[whole]] = True
        place = self._places(found, hard)[codes]
        size = self.count[place]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[place] - to[:-1], size) + np.arange(to[-1])]
        return ids, to[of]

    def _places(self, found: list[bytes], hard: np.ndarray) -> np.ndarray:
        if len(self.known) + len(found) > CACHE or len(self.flat) > 16 * CACHE:
            self._forget()
        places = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
        new = np.flatnonzero(places < 0)
        for group, ids_of in ((new[~hard[new]], self._merged), (new[hard[new]], self._whole)):
            names = [found[k] for k in group]
            if names:
                ids, count = ids_of(names)
                places[group] = np.arange(len(self.count), len(self.count) + len(names))
                self.known.update(zip(names, places[group].tolist(), strict=True))
                self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
                self.count = np.concatenate([self.count, count])
                self.flat = np.concatenate([self.flat, ids])
        return places

    def _merged(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        letters = self.letters
        spelt = [p.decode() if p.isascii() else p.decode("latin-1").translate(letters) for p in names]
        groups = [spelt[k : k + 256] for k in range(0, len(spelt), 256)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.merges.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(names):
            raise ValueError("the tokenizer doesn't mark the ends of words")
        return ids, np.diff(ends, prepend=0)

    def _whole(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in names], add_special_tokens=False)]
        return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)


_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of texts data[at[i]:at[i + 1]] of UTF-8, lower-cased where plain; which are
    whole words for the tokenizer; and at which piece each text begins, with their number."""
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # two bytes, of U+00C0 to U+00FF
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)  # not the signs of times and division
    lead, second = lead[letter], second[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    begins[n] = False

    solid = kind != _SPACE
    word = solid.copy()  # begins of words
    word[1:] &= ~solid[:-1] | begins[1:n]
    words = np.flatnonzero(word)
    start = solid & (kind == _DIGIT)
    start |= word
    start[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    first = np.flatnonzero(start)

    odd = kind == _OTHER
    odd[:-1] |= (data[:-1] == 39) & (kind[1:] == _LETTER)  # ' before a letter
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <|
    odd = np.flatnonzero(odd)
    whole = np.zeros(len(words), bool)
    whole[np.searchsorted(words, odd, "right") - 1] = True

    low = _LOWER[data]
    low[lead[second < 0x9F] + 1] += 0x20
    if len(odd):
        where = np.flatnonzero(whole)
        inside = np.zeros(n + 1, np.int8)
        inside[words[where]] += 1
        inside[np.append(words, n)[where + 1]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        low[inside] = data[inside]
        first = first[~inside[first] | word[first]]
        whole = inside[first]
    else:
        whole = np.zeros(len(first), bool)
    before = np.cumsum(solid, dtype=np.int64)  # bytes other than spaces, up to each
    offsets = np.append(before[first] - 1, before[-1]) if len(first) else np.zeros(1, np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])
    return pieces, whole, np.searchsorted(first, at)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its words from task to task."""
    return Encoder(path)


class Packer:
    """Packs pieces (doc, first byte, bytes) into full windows; emits them to out."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, waiting: int = WAITING):
        self.base, self.tiers, self.step_tokens, self.limit = base, tiers, step_tokens, waiting
        self.pool: dict[int, list] = {t: [] for t in tiers}  # of (length, order, doc, start, ids), sorted by length
        self.tokens = dict.fromkeys(tiers, 0)
        self.order = self.sequence = 0
        self.filled: dict[int, int] = {}
        self.out: list[tuple] = []

    def add(self, doc: tuple, ids: bytes) -> None:
        n, top, start = len(ids) // 4, self.tiers[-1], 0
        while n - start >= top:
            self._emit([(doc, start, ids[4 * start : 4 * (start + top)])], top)
            start += top
        if n > start:
            self._wait(doc, start, ids[4 * start :])

    def _wait(self, doc: tuple, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        tier = next(t for t in self.tiers if n <= t)
        if n == tier:
            self._emit([(doc, start, ids)], tier)
            return
        self.order += 1
        insort(self.pool[tier], (n, self.order, doc, start, ids), key=lambda p: p[:2])
        self.tokens[tier] += n
        if len(self.pool[tier]) > self.limit and self.tokens[tier] >= tier:
            self._fill(tier)

    def _fit(self, tier: int, gap: int):
        """The longest waiting piece of at most gap tokens, of this tier or else a shorter one."""
        for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):
            at = bisect_right(self.pool[t], gap, key=lambda p: p[0])
            if at:
                return self._take(t, at - 1)
        return None

    def _take(self, tier: int, at: int):
        piece = self.pool[tier].pop(at)
        self.tokens[tier] -= piece[0]
        return piece

    def _fill(self, tier: int) -> None:
        gap, pieces = tier, []
        while gap:
            found = self._fit(tier, gap)
            if found is None:  # cut the longest that waits, in this tier or below
                t = next(t for t in reversed(self.tiers[: self.tiers.index(tier) + 1]) if self.pool[t])
                n, _, doc, start, ids = self._take(t, -1)
                pieces.append((doc, start, ids[: 4 * gap]))
                self._wait(doc, start + gap, ids[4 * gap :])
                break
            n, _, doc, start, ids = found
            pieces.append((doc, start, ids))
            gap -= n
        self._emit(pieces, tier)

    def finish(self) -> None:
        """Packs all that waits, into windows of descending powers of two."""
        rest = [(doc, start, ids) for t in reversed(self.tiers) for _, _, doc, start, ids in reversed(self.pool[t])]
        self.pool = {t: [] for t in self.tiers}
        left, at, used = sum(len(x[2]) // 4 for x in rest), 0, 0
        size = self.tiers[-1]
        while left:
            while size > left:
                size //= 2
            gap, pieces = size, []
            while gap:
                doc, start, ids = rest[at]
                n = min(gap, len(ids) // 4 - used)
                pieces.append((doc, start + used, ids[4 * used : 4 * (used + n)]))
                gap, used = gap - n, used + n
                if used == len(ids) // 4:
                    at, used = at + 1, 0
            self._emit(pieces, size)
            left -= size

    def _emit(self, pieces: list, size: int) -> None:
        done = self.filled.get(size, 0)
        self.filled[size] = done + 1
        step = self.base | size << 24 | done * size // self.step_tokens
        offset = 0
        for (doc_id, total), start, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.base | self.sequence, offset, size, step))
            offset += n
        self.sequence += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of (doc_id, text) in turn, some CHUNK bytes of text at a time."""
    to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = to[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(to, done + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of docs(doc_id, text): the columns of SCHEMA.

    Cut freely, each id of a document lies in exactly one piece. tiers are powers of two; a
    sequence's tokens are exactly its tier, or a power of two below the least for a
    partition's last ones. step_id groups sequences of equal size into equal token counts.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer, encode = Packer((task.partitionId() if task else 0) << 40, tiers, step_tokens), encoder(tokenizer_path).encode

        def flush():
            rows, packer.out = packer.out, []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(_NAMES, cols, strict=True)], names=_NAMES)

        end = END.to_bytes(4, "little")
        for batch in batches:
            for part in _chunks(batch):
                ids, at = encode(part.column(1))
                for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add((doc_id, b - a + 1), ids[a:b].tobytes() + end)
                if len(packer.out) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
