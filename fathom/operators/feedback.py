"""Documents like the best hits: query expansion by the words that set the hits apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiler, Field, Node, Schema

N_RSET, N_ESET, N_TERM = 5, 32, 10


def expansion(schema: Schema, f: Field, ids: list, id_field: str, n_eset: int = N_ESET) -> list[tuple[str, float]]:
    """The n_eset words of the given documents with the greatest weight, best first.

    The weight of a word in r of R given and n of N documents is the classical one,
    r * log((r + .5)(N - n - R + r + .5) / ((n - r + .5)(R - r + .5))).
    """
    toks = Compiler(schema).tokens(f)
    given = schema.frame.where(F.col(id_field).isin(ids)).select(F.explode(F.array_distinct(toks)).alias("w")).groupBy("w").agg(F.count("*").alias("r"))
    # The words of the few given documents: what goes through the driver doesn't grow with the corpus.
    times = {x.w: x.r for x in given.collect()}
    if not times:
        return []
    held = F.array_distinct(F.filter(toks, lambda w: w.isin(list(times))))
    everywhere = schema.frame.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    in_given = schema.frame.sparkSession.createDataFrame(list(times.items()), "w string, r long")
    everywhere = everywhere.join(F.broadcast(in_given), "w")
    if "n" not in schema.known:
        schema.known["n"] = schema.frame.count()
    total, size = schema.known["n"], len(ids)
    r, n = F.col("r"), F.col("n")
    weight = r * F.log((r + 0.5) * (total - n - size + r + 0.5) / ((n - r + 0.5) * (size - r + 0.5)))
    best = everywhere.select("w", "n", F.round(weight, 9).alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "w").limit(n_eset).collect()
    schema.known.setdefault("df", {}).update({(f.key, x.w): x.n for x in best})
    return [(x.w, x.weight) for x in best]


def expanded(schema: Schema, fields: list[Field], ids: list, id_field: str, n_eset: int = N_ESET, n_term: int = N_TERM) -> Node:
    """The elite set of the best n_eset words of the fields' expansions, as a query."""
    found = [(weight, w, f) for f in fields for w, weight in expansion(schema, f, ids, id_field, n_eset)]
    best = sorted(found, key=lambda x: (-x[0], x[1], x[2].name))[:n_eset]
    comp = Compiler(schema)
    return comp.elite([comp.word(f, w) for _, w, f in best], n_term) if best else Node(F.lit(False), lambda _: F.lit(0.0))


def term_statistics(schema: Schema, f: Field) -> DataFrame:
    """word, documents (that hold it), total (occurrences) of every word of a text field.

    One aggregation by word: a document gives each of its words once, with the length of the
    word's run among its sorted tokens, so that tasks combine counts before the shuffle and no
    pair of word and document is shuffled.
    """

    def counted(ws: Column) -> Column:
        begins = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (w != F.get(ws, i - 1)), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(begins), lambda at: F.transform(at, lambda i, k: F.struct(F.get(ws, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - i).alias("n")))))

    sorted_words = F.array(F.sort_array(Compiler(schema).tokens(f)))
    rows = schema.frame.select(F.explode(F.flatten(F.transform(sorted_words, counted))).alias("x")).select("x.*")
    return rows.groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("total"))
