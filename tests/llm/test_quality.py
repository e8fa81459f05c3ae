import math
import random
from collections import Counter

from pyspark.sql import functions as F

from fathom.llm.quality import GRID, keep_good, learn, quality, statistics

from . import helpers


def brute(text):
    w = helpers.words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if helpers.words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    at = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(at)


def test_counts_are_those_of_plain_loops(spark):
    r = random.Random(8)
    texts = [None, "", " \t\n", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n \n \nx", "😀 é#*$ 😀 é#*$ 😀 é#*$", "a|b & <c> | |", "one two three  four", "w " * 70_000, "q\x1cq \x85 q"]
    texts += [" ".join(r.choice(["ab", "c#", "d\n", "\n", "é", "E!"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    got = {r[0]: tuple(r)[1:6] for r in statistics(frame).collect()}
    assert got == {d: brute(t) for d, t in enumerate(texts)}


def test_the_list_learns_what_bad_rows_have_in_common(spark):
    r = random.Random(3)
    docs, labels = [], []
    for d in range(500):
        bad = d % 5 == 0
        w = [f"{r.choice('bcdfg')}{r.randint(0, 10**6)}" for _ in range(r.randint(60, 120))]
        if bad:
            w = [x + "###" for x in w]
        docs.append((d, " ".join(w)))
        labels.append((d, int(not bad)))
    docs += [(1000, None), (1001, "too short")]
    found, rules = quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (1, 9), (None, 0)], "doc_id long, quality int"))
    got = {x.doc_id: x for x in found.collect()}
    assert rules and all(got[d].kept == bool(good) and not got[d].base_failed for d, good in labels)
    assert all(got[d].base_failed and not got[d].kept for d in (1000, 1001))


def test_without_labels_or_rows_only_the_base_rule_counts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "same " * 60), (None, None)], "doc_id long, text string")
    found, rules = quality(docs, labels)
    assert not rules and helpers.rows(found, "doc_id", "base_failed", "kept") == sorted([(1, False, True), (2, True, False), (None, True, False)], key=str)
    assert quality(docs.limit(0), labels)[0].collect() == []


def plain_covering(rows, seed_rows, max_rules=8, max_conditions=3, precision=0.9, support=8):
    """Sequential covering by loops over rows (features and whether bad) and the set that grows."""
    grow, prune = [x for d, x in rows.items() if seed_rows[d]], [x for d, x in rows.items() if not seed_rows[d]]
    out = []
    while len(out) < max_rules:
        conditions, held = [], grow
        while len(conditions) < max_conditions:
            of_p, of_n = sum(x["bad"] for x in held), sum(not x["bad"] for x in held)
            if not of_p or of_n <= 0.01 * of_p:
                break
            tried = []
            for f, grid in GRID.items():
                for t in grid:
                    for sign, fits in ((">=", lambda x, f=f, t=t: x[f] >= t), ("<", lambda x, f=f, t=t: x[f] < t)):
                        p, n = sum(x["bad"] for x in held if fits(x)), sum(not x["bad"] for x in held if fits(x))
                        gain = p * (math.log2(p / (p + n)) - math.log2(of_p / (of_p + of_n))) if p else 0.0
                        tried.append((gain, f"{f} {sign} {float(t)}D", fits))
            gain, text, fits = max(tried, key=lambda x: x[:2])
            if gain <= 1e-9:
                break
            conditions.append((text, fits))
            held = [x for x in held if fits(x)]
        if not conditions:
            break
        covered = lambda part, k: [x for x in part if all(f(x) for _, f in conditions[:k])]  # noqa: B023, E731
        worth = []
        for k in range(1, len(conditions) + 1):
            got = covered(prune, k)
            bad = sum(x["bad"] for x in got)
            worth.append(((2 * bad - len(got)) / len(got) if got else -1.0, -k))
        k = -max(worth, key=lambda x: (round(x[0], 3), x[1]))[1]
        got, grown = covered(prune, k), sum(x["bad"] for x in covered(grow, k))
        bad = sum(x["bad"] for x in got)
        if bad + grown < support or not bad or bad < precision * len(got):
            break
        out.append(([t for t, _ in conditions[:k]], bad, len(got) - bad))
        grow, prune = ([x for x in part if not all(f(x) for _, f in conditions[:k])] for part in (grow, prune))
    return out


def test_the_learner_is_plain_sequential_covering(spark):
    r = random.Random(5)
    docs, labels = [], []
    for d in range(700):
        kind = r.choice(["good", "good", "good", "symbols", "short", "repeats"])
        w = [f"{r.choice('bcdfg')}{r.choice(['a', 'o'])}{r.randint(0, 999)}" for _ in range(r.randint(55, 90))]
        if kind == "symbols":
            w = [x + "##" if r.random() < 0.6 else x for x in w]
        if kind == "short":
            w = [x[:2] for x in w]
        if kind == "repeats":
            w = w[:20] * 4
        docs.append((d, " ".join(w)))
        labels.append((d, int((kind == "good") != (r.random() < 0.03))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stats = statistics(frame)
    bad = {d: not q for d, q in labels}
    rows = {x.doc_id: {f: x[f] for f in GRID} | {"bad": bad[x.doc_id]} for x in stats.collect()}
    grows = {x.doc_id: x.g for x in frame.select("doc_id", (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) > 0).alias("g")).collect()}
    got = learn(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [(x.conditions, x.bad, x.good) for x in got] == plain_covering(rows, grows) and len(got) >= 2


def test_windows_of_very_long_texts_are_compared_alike(spark, monkeypatch):
    texts = ["a b c a b c d", "x y z " * 40, " ".join(map(str, range(90))), "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr("fathom.llm.quality._BITS", 4)  # 16 words and more take the other path
    assert {r[0]: tuple(r)[1:6] for r in statistics(frame).collect()} == {d: brute(t) for d, t in enumerate(texts)}


def test_rows_are_kept_by_their_own_text(spark):
    good = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(1, good, "a", 1), (1, "short", "b", 2), (None, good, "c", 3), (2, None, "d", 4)], "doc_id long, text string, row string, n_words int")
    got = keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert got.columns == docs.columns and sorted(x.row for x in got.collect()) == ["a", "c"]
