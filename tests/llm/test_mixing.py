import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fathom.llm.mixing import budgets, mix, shares


def test_shortages_go_to_siblings_before_ancestors():
    assert shares(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert shares(10, [1, 0], [3, 50]) == [3, 0]
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert budgets(tokens, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    assert budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert budgets(tokens, 200, {("a",): 0.0}, 1)["b", "z"] == 200


@pytest.mark.parametrize("epochs, total", [(1, 0.5), (4, 3000)])
def test_each_leaf_gets_its_budget_as_a_seeded_prefix(spark, epochs, total):
    r = random.Random(epochs)
    docs = [(d, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 40]))), r.choice(["en", "de", None]), r.choice(["s0"] * 5 + ["s1", "s2", None]), d) for d in range(300)]
    docs += docs[:20] + [(900, None, "en", "s0", 0), (None, "a b", "en", "s0", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_tokens int").repartition(3)
    levels = [("lang", F.col("lang")), ("source", F.col("source"))]
    found = mix(frame, levels, {("en",): 2.0}, total, epochs=epochs).collect()
    tokens, rows = Counter(), Counter()
    for d, t, lang, source, _ in docs:
        n = len((t or "").split())
        tokens[lang or "unknown", source or "unknown"] += n
        rows[d] += n > 0
    tokens = {k: v for k, v in tokens.items() if v}
    wanted = budgets(tokens, total if isinstance(total, int) else int(total * sum(tokens.values())), {("en",): 2.0}, epochs)
    taken, cut, seen = Counter(), Counter(), defaultdict(Counter)
    for x in found:
        leaf = x.lang, x.source
        taken[leaf] += x.take_tokens
        cut[leaf] += x.take_tokens < x.n_tokens
        seen[leaf, x.epoch][x.doc_id] += 1
        assert 0 < x.take_tokens <= x.n_tokens
    assert dict(taken) == {k: v for k, v in wanted.items() if v}
    assert max(cut.values(), default=0) <= 1
    assert all(n <= rows[d] for c in seen.values() for d, n in c.items())
    again = mix(frame.repartition(7), levels, {("en",): 2.0}, total, epochs=epochs).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_the_prefix_is_that_of_a_plain_sort(spark):
    r = random.Random(12)
    docs = [(d, " ".join(["w"] * r.choice([1, 2, 9, 30])), r.choice(["s0", "s0", "s0", "s1"]), f"row {d}") for d in range(400)]
    docs += [(7, docs[7][1], docs[7][2], f"copy {k}") for k in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, note string")
    total, seed = 3000, 5
    hashes = {}
    for epoch in range(5):
        own = F.xxhash64("doc_id", "text")
        for x in frame.select("note", F.xxhash64(F.lit(seed), F.lit(epoch).cast("long"), own).alias("h"), F.xxhash64("doc_id", "note").alias("tie")).collect():
            hashes[epoch, x.note] = x.h % 2**64, x.tie
    tokens = Counter()
    for _, t, source, _ in docs:
        tokens[source,] += len(t.split())
    want = []
    for leaf, budget in budgets(dict(tokens), total, {("s1",): 3.0}, 4).items():
        mine = [(note, len(t.split())) for _, t, source, note in docs if source == leaf[0]]
        whole, rest = divmod(budget, tokens[leaf])
        want += [(note, e, n) for e in range(whole) for note, n in mine]
        for note, n in sorted(mine, key=lambda x: (hashes[whole, x[0]][0], x[1], hashes[whole, x[0]][1])):
            if rest > 0:
                want.append((note, whole, min(n, rest)))
                rest -= n
    found = mix(frame.repartition(5), [("source", F.col("source"))], {("s1",): 3.0}, total, epochs=4, seed=seed, keep=["doc_id", "note"])
    assert sorted((x.note, x.epoch, x.take_tokens) for x in found.collect()) == sorted(want)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(frame, [("source", F.col("source"))], {}, 0.5).collect() == []
