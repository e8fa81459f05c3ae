import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm.packing import Encoder, Packer, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = Encoder(PATH)


def texts():
    r = random.Random(5)
    odd = ["", " ", "it's DON'T 'tis '' l'été Été É", "naïve co-op 3.14 $%&| <b>x</b>", "ΣΑΣ Straße İstanbul ǅ", "á a b c​d", "…—“q” 😀👍🏽 你好 世界", "x" * 9000, "\x00\x01 \x0b \x0c \x1c y", "a<|endoftext|>b <|startoftext|> (<|endoftext|>) <|end|>", "foo_bar __init__ ''s 's 'S n't I'm I'M"]
    return odd + [" ".join(r.choice(["the", "Toxic,", "word's", "(end)", "é", "12", "Über-haupt", "don't", "\n"]) for _ in range(r.choice([1, 10, 700, 3000, 9000]))) for _ in range(30)]


def ids_of(encoder, some):
    ids, at = encoder.encode(pa.array(some, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_ids_are_the_tokenizers():
    encoder = Encoder(PATH)
    some = texts()
    assert ids_of(encoder, some) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


LETTERS = "aZéÉßÞ×÷ÿŸİığ'\"<|>.-_09²¼ª \t\n\r\x0b\x0c\x00\x1c\x7f\xa0\xad\u0301\u2028ЖжΣσς中😀"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(LETTERS), st.sampled_from(["'s", "'LL", "don't", "<|endoftext|>", "The"]), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join), max_size=5))
def test_ids_of_any_texts_are_the_tokenizers(some):
    assert ids_of(ENCODER, some) == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr("fathom.llm.packing.CACHE", 20)
    encoder = Encoder(PATH)
    some = [f"(word{'abcdefgh'[k % 8]}{'xyz'[k % 3]}, {'qrstuv'[k % 6] * (k % 9)}) end" for k in range(200)]
    for t in some:
        assert ids_of(encoder, [t]) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_pieces_restore_every_document_and_sequences_have_no_gaps(spark):
    whole = Encoder(PATH).tokenizer
    docs = dict(enumerate(texts())) | {1000: None}
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, offset string").repartition(3)
    found = pack(frame, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for d, t in docs.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # a power of two: nothing is padded
    assert len({(r.sequence_id, r.step_id) for r in found}) == len(by_sequence)


def test_a_group_of_steps_holds_equal_tokens():
    packer = Packer(0)
    r = random.Random(1)
    for d in range(3000):
        packer.add((d, 0), b"\x01\0\0\0" * r.choice([3, 60, 500, 900, 1500, 5000]))
    packer.finish()
    tokens = defaultdict(int)
    for x in packer.out:
        tokens[x[8]] += x[2]
    assert max(tokens.values()) == packer.step_tokens
    per_tier = defaultdict(list)
    for k, v in tokens.items():
        per_tier[k >> 24].append(v)
    assert all(sum(v < packer.step_tokens for v in t) <= 1 for t in per_tier.values())


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
