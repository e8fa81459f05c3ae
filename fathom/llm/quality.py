"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Each document's statistics come from array functions within its row, so nothing is shuffled
for them. The list is learned by sequential covering: a rule grows one threshold condition at
a time by FOIL's gain, is pruned on rows that it wasn't grown on, and is kept if it is
precise there; then the rows that it covers are set aside and the next one grows. Every step
reads one histogram, counted by Spark over all labelled rows. The rules come out as an
ordered CASE WHEN.

Null and empty texts have no words, and fail the base rule. Statistics read whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, discard, saved

#: Thresholds that a condition may have, by feature.
_SHARES = [0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
_SIZES = [50, 75, 100, 150, 200, 300, 500, 750, 1000, 2000, 5000, 10000]
GRID: dict[str, list[float]] = {
    "n_words": _SIZES, "mean_word": [2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 7.5, 8, 9, 10, 12, 15, 20], "symbol_share": _SHARES, "dup_line_share": _SHARES,
    "repeat_share": _SHARES, "upper_share": _SHARES, "mark_share": _SHARES, "digit_share": _SHARES, "distinct_share": _SHARES, "bar_share": _SHARES,
}
_BITS = 24  # of a packed window that hold its place; longer texts compare all windows


def _chars(keep: str) -> Column:
    return F.length(F.regexp_replace("text", f"[^{keep}]+", ""))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the shares of GRID (double).

    With carry, "row" holds all columns of docs beside these.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    kept = ["doc_id", "row"] if carry else ["doc_id"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select(
        *kept,
        F.array_remove(F.split("text", WORD_BREAK), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _chars(r"#*$%&|<>").cast("long").alias("n_symbols"),
        _chars(r"\p{Lu}").alias("n_upper"),
        _chars("!?").alias("n_marks"),
        _chars("0-9").alias("n_digits"),
    )
    sized = split.select(
        *kept, "words", "n_symbols", "n_upper", "n_marks", "n_digits",
        F.size("words").alias("n"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("n_own_lines"),
        F.size(F.array_distinct("words")).alias("n_own_words"),
        F.size(F.array_compact(F.transform("words", lambda w: F.when(w == "|", F.lit(1))))).alias("n_bars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hash"),
    )
    others = [c for c in sized.columns if c not in ("hash", "words")]
    mask = F.lit(-1 << _BITS)
    packed = sized.select(
        *others, "words",
        F.sort_array(F.array_compact(F.transform("hash", lambda x, i: F.when(i < F.col("n") - 2, F.xxhash64(x, F.get("hash", i + 1), F.get("hash", i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("long")))))).alias("packed"),
    )

    def alike(items: str, key, i: Column, x: Column) -> Column:
        return (key(x) == key(F.get(items, i - 1))) | (key(x) == key(F.get(items, i + 1)))

    high = lambda x: F.shiftright(x, _BITS)
    place = F.lit((1 << _BITS) - 1)
    maybe = packed.select(
        *others, "words",
        F.when(F.col("n") < 1 << _BITS, F.array_compact(F.transform("packed", lambda x, i: F.when(alike("packed", high, i, x), x.bitwiseAND(place).cast("int")))))
        .otherwise(F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0)))).alias("maybe"),
    )
    texts = maybe.select(*others, F.sort_array(F.transform("maybe", lambda p: F.struct(F.concat_ws(" ", F.get("words", p), F.get("words", p + 1), F.get("words", p + 2)).alias("g"), p.alias("p")))).alias("found"))
    twice = texts.select(*others, F.array_compact(F.transform("found", lambda x, i: F.when(alike("found", lambda s: s["g"], i, x), x["p"]))).alias("at"))
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda p: p + 1), F.transform("at", lambda p: p + 2))))
    n, chars = F.greatest("n", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return twice.select(
        *kept,
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("n_own_lines")).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        ((F.col("n_lines") - F.col("n_own_lines")) / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (covered / n).alias("repeat_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_marks") / n).alias("mark_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_own_words") / n).alias("distinct_share"),
        (F.col("n_bars") / n).alias("bar_share"),
    )


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


@dataclass
class Rule:
    """A conjunction of threshold conditions, as SQL, with its counts on the pruning rows."""

    conditions: list[str] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    @property
    def sql(self) -> str:
        return " and ".join(self.conditions) if self.conditions else "true"


def decision_list(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that rejects a row, null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(rule.sql), F.lit(k)).otherwise(out)
    return out


def _gain(p: int, n: int, of_p: int, of_n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(of_p / (of_p + of_n))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, support: int = 8, seed: int = 11) -> list[Rule]:
    """Rules that reject rows like those of labels(doc_id, quality) with quality 0.

    Two thirds of the labelled rows grow rules, the others prune and judge them. A rule stays
    if the pruning rows that it covers are bad to the stated precision, and both parts hold
    `support` bad ones together. Without labels of both kinds there are no rules.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    bins = [F.expr(f"size(filter(array({', '.join(f'{float(t)}D' for t in grid)}), t -> t <= {f}))") for f, grid in GRID.items()]
    rows = stats.join(marked, "doc_id").select("doc_id", *GRID, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) > 0).alias("grow"), F.array(*bins).alias("bins"))
    rows = saved(rows, "marked")
    names, rules, left = list(GRID), [], "true"

    def histogram(where: str) -> list[list[list[int]]]:
        """[feature][bin][bad], over the growing rows."""
        out = [[[0, 0] for _ in range(len(GRID[f]) + 1)] for f in names]
        seen = rows.where(f"grow and ({where})").select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin", "bad").count()
        for r in seen.collect():
            out[r.f][r.bin][r.bad] = r["count"]
        return out

    def judge(conditions: list[str], grow: bool) -> list[tuple[int, int]]:
        """(bad, good) of each beginning of the conjunction."""
        cols = []
        for k in range(1, len(conditions) + 1):
            held = F.expr(" and ".join(conditions[:k]))
            cols += [F.coalesce(F.sum(F.when(held, F.col("bad"))), F.lit(0)), F.coalesce(F.sum(F.when(held, 1 - F.col("bad"))), F.lit(0))]
        got = rows.where(f"{'' if grow else 'not '}grow and ({left})").agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return [(got[2 * k], got[2 * k + 1]) for k in range(len(conditions))]

    for _ in range(max_rules):
        rule = Rule()
        while len(rule.conditions) < max_conditions:
            counts = histogram(f"({left}) and {rule.sql}")
            of_n, of_p = (sum(b[y] for b in counts[0]) for y in (0, 1))
            if not of_p or of_n <= 0.01 * of_p:
                break
            best = (0.0, "")
            for f, per_bin in zip(names, counts, strict=True):
                n = p = 0
                for k, t in reversed(list(enumerate(GRID[f]))):  # f >= t holds in bins over k
                    n, p = n + per_bin[k + 1][0], p + per_bin[k + 1][1]
                    for sign, q, m in ((">=", p, n), ("<", of_p - p, of_n - n)):
                        best = max(best, (_gain(q, m, of_p, of_n), f"{f} {sign} {float(t)}D"))
            if best[0] <= 1e-9:
                break
            rule.conditions.append(best[1])
        if not rule.conditions:
            break
        pruning, growing = judge(rule.conditions, False), judge(rule.conditions, True)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruning]
        k = max(range(len(worth)), key=lambda i: (round(worth[i], 3), -i))
        rule = Rule(rule.conditions[: k + 1], *pruning[k])
        if rule.bad + growing[k][0] < support or not rule.bad or rule.bad < precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        left = f"{left} and not ({rule.sql})"
    discard(rows)
    return rules


def keep_good(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The rows of docs that quality() keeps, each judged by its own text.

    They are written once with their statistics, learnt from and filtered there; no text is shuffled.
    """
    stats = saved(statistics(docs, carry=True), "stats")
    good = ~F.expr(BASE_FAILED) & decision_list(learn(stats, labels, **learning)).isNull()
    return stats.where(good).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality(docs: DataFrame, labels: DataFrame, **learning) -> tuple[DataFrame, list[Rule]]:
    """One row per row of docs: doc_id, the counts, base_failed, kept, rule; and the rules.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept:
    neither that nor rejected by the decision list; rule is the list's number or null.
    """
    stats = saved(statistics(docs), "stats")
    rules = learn(stats, labels, **learning)
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), decision_list(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
