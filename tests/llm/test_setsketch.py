import random

import numpy as np
import pytest

from fathom.llm.common import components
from fathom.llm.setsketch import REGISTERS, joint_estimate, near_duplicates, parities, shingle_sets, sketches

from . import helpers


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            near = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", "\t \x0b"]).join(x.upper() if r.random() < 0.3 else x for x in near))
    return dict(enumerate(texts))


def test_components_and_sizes_are_those_of_all_pairs(spark):
    texts = corpus(3)
    n = len(texts)
    texts |= {n: None, n + 1: "", n + 2: " \n\t ", n + 3: "One", n + 4: "one", n + 5: "Été été", n + 6: "été été"}
    hot = " ".join(f"h{i}" for i in range(200))
    texts |= {n + 10 + i: hot + f" tail{i % 7}" for i in range(80)}  # a group of near copies
    rows = [(d, t, "x", 0) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int").repartition(5)
    found = near_duplicates(docs, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == helpers.near_groups(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("few", [0, 32])
def test_pages_of_a_template_about_the_threshold(spark, monkeypatch, few):
    monkeypatch.setattr("fathom.llm.setsketch.FEW", few)
    r = random.Random(6)
    texts = {}
    for t in range(2):  # whole templates with own parts of about a fifth, of which some are taken from few variants
        frame = [f"t{t}x{i}" for i in range(120)]
        for k in range(70):
            own = [r.choice([f"v{t}{r.randrange(4)}", f"o{t}{k}"]) + f"y{i}" for i in range(r.randint(8, 24))]
            texts[100 * t + k] = " ".join(frame[: r.randint(50, 70)] + own + frame[70:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = near_duplicates(docs, words=3).collect()
    want = helpers.near_groups(texts, 3, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == want
    assert 2 < len({c for _, c in want.values()}) < len(texts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u v"), (2, "A B C D E"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    got = helpers.rows(near_duplicates(docs, words=5), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (None, 1, 1, True), (None, 0, None, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 3000, dtype=np.uint64)) for s in (1, 2))
    both = np.union1d(a, b)
    left, right, union = sketches([a, b, both])
    assert (np.maximum(left, right) == union).all()
    x = np.concatenate([a[:2000], b])
    one, two = sketches([np.unique(x), both])
    true = len(np.intersect1d(x, both)) / len(np.union1d(x, both))
    assert abs(joint_estimate([len(np.unique(x))], [len(both)], np.array([(one > two).sum()]), np.array([(one < two).sum()]))[0] - true) < 5 / REGISTERS**0.5


def test_parities_differ_in_no_more_bins_than_sets_in_shingles():
    r = np.random.default_rng(5)
    for n in (1, 5, 100, 900, 5000):
        a = np.unique(r.integers(0, 2**63, n)).astype(np.int64)
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3)])).astype(np.int64)
        p, q, same = parities([a, b, a.copy()])
        apart = sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))
        assert (p == same).all() and apart <= len(np.setxor1d(a, b)) and (n < 100 or apart > 20)


def test_long_texts_are_read_whole(monkeypatch):
    r = random.Random(4)
    some = [" ".join(r.choice(["a", "bc", "d" * 40, "é\t", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(50)]
    whole = [x.tolist() for x in shingle_sets(some, 3)]
    monkeypatch.setattr("fathom.llm.setsketch.PIECE", 16)
    assert [x.tolist() for x in shingle_sets(some, 3)] == whole and [len(x) for x in whole] == [len(helpers.shingles(x, 3)) for x in some]
    monkeypatch.undo()
    long = " ".join(f"x{i}" for i in range(200_000))
    one, two = shingle_sets([long, long + " end"], 5)
    assert (len(one), len(two)) == (199_996, 199_997)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100)
