"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets go down the tree. A node's budget is shared among its children by weight; a child
that can't use its share (its subtree holds too few tokens, over all allowed epochs) takes
what it can, and what it leaves goes to its siblings by weight. Only what a whole subtree
can't use is left to its parent's siblings. A leaf of b budgeted and T available tokens
gives every document in each of b div T whole epochs, and in the next epoch the first
b mod T tokens of the leaf's documents in a seeded order, the last of them cut.

The prefix is found without sorting a leaf: hashes in the order's place fall into 256
buckets, and the bucket in which the prefix ends into 256 more; only documents of that last
bucket are ordered. So a leaf with a third of all rows is no task of its own.

Null levels count as "unknown"; null and empty texts hold no tokens and aren't selected.
Rows that repeat a doc_id count each; those of one id and text are in the order of a hash of
the columns that are kept. A token is a word, a run of non-space characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BREAK, saved

MAX_LEAVES = 100_000
UNKNOWN = "unknown"


def shares(budget: int, weights: list[float], capacity: list[int]) -> list[int]:
    """budget shared by weight within capacities; what some can't take goes to the others."""
    out = [0] * len(weights)
    left = min(budget, sum(c for c, w in zip(capacity, weights, strict=True) if w > 0))
    live = [k for k, w in enumerate(weights) if w > 0 and capacity[k] > 0]
    while left and live:
        total = sum(weights[k] for k in live)
        full = [k for k in live if left * weights[k] / total >= capacity[k]]
        if full:
            for k in full:
                out[k] = capacity[k]
            left -= sum(capacity[k] for k in full)
            live = [k for k in live if k not in full]
            continue
        exact = {k: left * weights[k] / total for k in live}
        for k in live:
            out[k] = int(exact[k])
        rest = left - sum(out[k] for k in live)
        for k in sorted(live, key=lambda k: (out[k] - exact[k], k)):  # largest remainders
            if rest and out[k] < capacity[k]:
                out[k] += 1
                rest -= 1
        left = 0
    return out


def budgets(tokens: dict[tuple[str, ...], int], total: int, weights: dict[tuple[str, ...], float], epochs: int) -> dict[tuple[str, ...], int]:
    """The budget of each leaf of tokens (leaf path -> tokens); an unlisted node weighs 1."""
    children: dict[tuple[str, ...], set] = {}
    room: dict[tuple[str, ...], int] = {}
    for leaf, n in tokens.items():
        usable = all(weights.get(leaf[: k + 1], 1.0) > 0 for k in range(len(leaf)))
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0) + n * epochs * usable
            if k < len(leaf):
                children.setdefault(leaf[:k], set()).add(leaf[: k + 1])
    out: dict[tuple[str, ...], int] = {}
    todo = [((), min(total, room.get((), 0)))]
    while todo:
        node, budget = todo.pop()
        if node in children:
            below = sorted(children[node])
            todo += zip(below, shares(budget, [weights.get(c, 1.0) for c in below], [room[c] for c in below]), strict=True)
        else:
            out[node] = budget
    return out


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_BREAK), "")).cast("long")


def mix(docs: DataFrame, levels: list[tuple[str, Column]], weights: dict[tuple[str, ...], float], total: int | float, epochs: int = 4, seed: int = 1, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The selected documents: the columns of keep, the levels, epoch, n_tokens, take_tokens.

    levels name the tree's levels from the top with their columns. total is a number of
    tokens, or a float for that share of all. take_tokens is less than n_tokens for the last
    document of a leaf's prefix alone. A document has a row for each epoch that holds it.
    """
    names = [f"level_{k}" for k in range(len(levels))]
    keep = ["doc_id"] if keep is None else keep
    base = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], *[F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(n) for n, (_, c) in zip(names, levels, strict=True)], word_count(F.col(text_col)).alias("n_tokens"), F.xxhash64("doc_id", F.col(text_col)).alias("own")).where("n_tokens > 0")
    spark = docs.sparkSession
    light = saved(base.select(*names, "n_tokens", "own"), "tokens")  # texts are read for this and for the result alone
    counted = light.groupBy(*names).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(counted) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[n] for n in names): r["n"] for r in counted}
    wanted = total if isinstance(total, int) else int(total * sum(tokens.values()))
    plan = [(*leaf, b // tokens[leaf], b % tokens[leaf]) for leaf, b in sorted(budgets(tokens, wanted, weights, epochs).items()) if b]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    leaves = F.broadcast(spark.createDataFrame(plan, schema))  # MAX_LEAVES rows at most

    def placing(part: DataFrame) -> DataFrame:
        found = part.join(leaves, names).withColumn("hash", F.xxhash64(F.lit(seed), "whole", "own"))
        return found.withColumn("b1", F.shiftrightunsigned("hash", 56).cast("int")).withColumn("b2", F.shiftrightunsigned("hash", 48).bitwiseAND(F.lit(255)).cast("int"))

    rows = placing(light)

    def cut(within: DataFrame, bucket: str, given: list[str]) -> DataFrame:
        """The bucket in which each leaf's prefix ends, with the tokens before it."""
        sums = within.where("rest > 0").groupBy(*names, *given, "rest", bucket).agg(F.sum("n_tokens").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy(bucket)))
        start = F.coalesce("before", F.lit(0)) if given else F.lit(0)
        return upto.where((start + F.col("upto") >= F.col("rest")) & (start + F.col("upto") - F.col("n") < F.col("rest"))).select(*names, F.col(bucket).alias(f"cut_{bucket}"), (start + F.col("upto") - F.col("n")).alias("at"))

    first = cut(rows, "b1", []).withColumnRenamed("at", "before")
    inside = rows.join(F.broadcast(first), names).where("b1 = cut_b1")
    second = cut(inside, "b2", ["before"]).withColumnRenamed("at", "offset")
    placed = placing(base).join(F.broadcast(first.drop("before").join(second, names)), names, "left")
    ends = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    early = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    out = [*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(n).alias(title) for n, (title, _) in zip(names, levels, strict=True)], F.col("epoch").cast("int").alias("epoch"), "n_tokens", F.col("take").alias("take_tokens")]
    full = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<long>"))
    extra = F.when(early, F.array("whole")).otherwise(F.array().cast("array<long>"))
    whole = placed.withColumn("epoch", F.explode(F.concat(full, extra))).withColumn("take", F.col("n_tokens")).select(*out)
    tie = F.xxhash64(*[f"keep_{i}" for i in range(len(keep))])  # of rows of one id and text
    order = Window.partitionBy(*names).orderBy("hash", "n_tokens", tie).rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where(ends).withColumn("prior", F.col("offset") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("prior < rest")
    last = last.withColumn("take", F.least("n_tokens", F.col("rest") - F.col("prior"))).withColumn("epoch", F.col("whole")).select(*out)
    return whole.unionByName(last)
