import random
import zlib

import pytest

from fathom.llm import toxicity as t


@pytest.fixture(scope="module")
def lm():
    r = random.Random(2)
    plain = "the small river runs past blighter villages where idiot scoundrel people gather every morning to trade bread".split()
    text = " ".join(r.choice(plain) for _ in range(5000))
    import numpy as np
    import pyarrow as pa

    found = next(t._count_grams(iter([pa.record_batch({"text": [text]})])))
    n = np.zeros(t.LETTERS**t.ORDER)
    n[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return t.smoothed(n.reshape((t.LETTERS,) * t.ORDER))


@pytest.mark.parametrize("span, word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("sc0undr3l", "scoundrel"), ("iiiidiot", "idiot"), ("i d i o t", "idiot"), ("$coundrel", "scoundrel")])
def test_decoding_restores_disguised_words(lm, span, word):
    assert word in t.decode(span, lm)


def test_plain_words_stay(lm):
    assert t.restore("river,", lm) == ("river",)
    assert t.spaced("a i d i o t went".split()) == ["a i d i o t"]


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    plain = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("nu", "ras", "pel") for c in ("do", "kin", "a")]
    rude = ["blarghead", "snotface", "grubwit"]
    docs, labels = [], []
    for d in range(600):
        text = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = d % 4 == 0
        if toxic:
            w = r.choice(rude)
            w = r.choice([w, w.upper(), w.replace("a", "4").replace("e", "3"), ".".join(w), w.replace("b", "bbbb"), " ".join(w)])
            text.insert(r.randrange(len(text)), w)
        docs.append((d, " ".join(text), "en", 0.5))
        labels.append((d, int(toxic)))
    docs += [(9001, None, None, None), (9002, "", "de", 0.0), (None, "lone row", "en", 0.1), (7, docs[7][1], "en", 0.5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    found = t.toxicity(frame, spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")).collect()
    assert len(found) == len(docs)
    truth = dict(labels)
    held = [x for x in found if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in found if x.doc_id is not None)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held) and len(held) > 80
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found)
    odd = {x.doc_id: x for x in found if x.doc_id in (9001, 9002)}
    assert odd[9001].score == odd[9002].score < 0.5


def test_no_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in t.toxicity(frame, labels).collect()] == [0]
    assert t.toxicity(frame.limit(0), labels).collect() == []


@pytest.mark.parametrize("token, word", [('"$coundrel', "scoundrel"), ("$coundrel!!", "scoundrel"), ("$coundrel***", "scoundrel"), ("!diot***", "idiot"), ("idiiot", "idiot"), ("scounddrel", "scoundrel"), ("(1d1ot).", "idiot")])
def test_edges_and_doubled_letters_are_decoded(lm, token, word):
    assert word in t.restore(token, lm)


def test_punctuation_ends_a_spaced_run(lm):
    assert t.spaced("so i d i o t! he said".split()) == ["i d i o t"]
    assert t.spaced('"i d i o t", x'.split()) == ["i d i o t"]
    assert t.spaced("a, b, c, d".split()) == []
    assert "idiot" in t.Restorer(lm).words("you i d i o t.")


def readings(span, lm):
    """Every path through the lattice of a span: (score, text)."""
    import math

    paths = [(0.0, "", (0, 0, 0), "")]
    for ch in span:
        new = []
        for score, text, past, source in paths:
            gram = lambda c, past=past: float(lm[((past[0] * 28 + past[1]) * 28 + past[2]) * 28 + c])
            options = ([(ch, 0.0)] if ch.isalpha() else []) + [(x, t.SWAP) for x in t.LEET.get(ch, "")]
            for x, cost in options:
                c = ord(x) - 96 if "a" <= x <= "z" else 27
                new.append((score + cost + gram(c), text + x, (*past[1:], c), x))
                if x == source:
                    new.append((score + cost + t.REPEAT, text, past, source))
            if not ch.isalnum() or not options:
                new.append((score + t.DROP, text, past, source))
            if not ch.isalnum():
                new.append((score + t.SPLIT + gram(0), text + " ", (*past[1:], 0), ""))
        paths = new
    return [(score + float(lm[((p[0] * 28 + p[1]) * 28 + p[2]) * 28]), text) for score, text, p, _ in paths if math.isfinite(score)]


def test_decoding_finds_the_best_of_all_readings(lm):
    r = random.Random(8)
    for _ in range(400):
        span = "".join(r.choice("idotscre10|!$.é5 ") for _ in range(r.randint(1, 7)))
        every = sorted(readings(span, lm))
        if len(every) == 1 or every[-1][0] - every[-2][0] > 1e-9:
            assert t.decode(span, lm.tolist()) == every[-1][1].split(), span


def test_one_doubled_letter_is_decided_as_by_decoding(lm):
    r = random.Random(9)
    for _ in range(2000):
        word = "".join(r.choice("idiotscé") for _ in range(r.randint(1, 9)))
        at = r.randrange(len(word))
        word = word[: at + 1] + word[at:]
        if sum(a == b for a, b in zip(word, word[1:], strict=False)) == 1:
            i = next(i for i in range(1, len(word)) if word[i] == word[i - 1])
            assert [t.undoubled(word, i, lm.tolist())] == t.decode(word, lm.tolist()), word


def test_long_spans_take_time_in_proportion(lm):
    import time

    began = time.time()
    for span in ("|3$a!" * 20_000, "1 2 3 " * 20_000, "ab" * 200_000):
        assert t.decode(span, lm.tolist())
    assert time.time() - began < 60


def test_the_fit_is_a_minimum():
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(int(r.random() < 0.3 + 0.4 * (k % 2)), [w for w in range(5) if r.random() < 0.3 or (w == k % 2)]) for k in range(400)]

    def loss(b, w):
        z = np.array([b + sum(w[k] for k in ks) for _, ks in rows])
        y = np.array([y for y, _ in rows])
        return (np.logaddexp(0, z) - y * z).sum() + 0.1 * (w**2).sum()

    b, w = t.fit(rows, 5)
    best = loss(b, w)
    for _ in range(300):
        assert loss(b + r.normal() * 0.05, w + r.normal(size=5) * 0.05) >= best - 1e-6
