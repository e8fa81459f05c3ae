import random

from pyspark.sql import functions as F

from fathom.llm.topk import quantised, top_k


def brute(rows, ask, k):
    out = []
    for q, v in rows:
        if ask(q):
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(v) == len(w)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_the_best_rows_are_those_of_a_full_scan_with_ties_and_several_slabs(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-3, -1, 0, 0, 1, 2]) for _ in range(6)]) for i in range(0, 400)]
    rows += [(400 + i, [1, 1, 1, 1, 1, 1]) for i in range(50)] + [(450, [0] * 6), (451, [5, 5])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    asked = frame.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
    want = brute(rows, lambda q: q % 25 == 0, 5)
    for slab, block in ((8192, 512), (64, 4)):
        assert sorted(tuple(x) for x in top_k(frame, asked, 5, slab, block).collect()) == want


def test_quantising_leaves_out_vectors_that_are_not_finite(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (50, [1.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = frame.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    assert {r.vec_id: r.vector for r in q.collect() if r.vector} == {0: [128, -1], None: [256, 256], 50: [256, -256]}
    asked = q.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert sorted(tuple(x) for x in top_k(q, asked, 5).collect()) == [(0, 1, 50, 128 * 256 + 256), (50, 1, 0, 128 * 256 + 256)]
    assert top_k(q.limit(0), asked.limit(0), 5).collect() == []
