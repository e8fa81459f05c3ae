"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame.

All but packing return the columns of docs. Labels come from the labels table of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WORD_BREAK, saved, table
from .queries import DOMAIN, MIX


def written(df: DataFrame, name: str) -> DataFrame:
    return saved(df, name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more; nothing but statistics is shuffled."""
    from .toxicity import model, score

    found = model(docs, table(spark, sf_dir, "labels"))
    return score(docs, *found, name="__toxicity").where("__toxicity < 0.5").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or that the decision list rejects."""
    from .quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the least doc_id.

    Where ids repeat or are null, rows get numbers of their own first, so that each is judged
    by its own text, and the first row of each group stays.
    """
    from .setsketch import near_duplicates

    named, key = docs, "doc_id"
    unclear = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not unclear.isEmpty():
        key = "__row" + "_" * max(map(len, docs.columns))  # no column has that name
        named = saved(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = saved(near_duplicates(named, words=5, percent=80, id_col=key), "groups")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).hint("merge")  # a share of all: merged at every size
    return named.join(gone, key, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each leaf's share of 75 % of the tokens, in one epoch; a cut document's text is cut."""
    from .mixing import mix

    whole = docs.select("doc_id", "text", F.expr(DOMAIN).alias("domain"), F.col("lang").alias("language"), F.col("source").alias("origin"), F.struct(*docs.columns).alias("row"))
    levels = [("level_domain", F.col("domain")), ("level_lang", F.col("language")), ("level_source", F.col("origin"))]
    found = mix(whole, levels, MIX, 0.75, epochs=1, keep=["row"])
    cut = F.col("take_tokens") < F.col("n_tokens")
    # The cut keeps the text up to the end of its last word: words and the breaks before them, in turn.
    words, breaks = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.regexp_extract_all("row.text", F.lit(f"(?:^|{WORD_BREAK})(?={WORD})"), F.lit(0))
    upto = F.greatest(F.col("take_tokens"), F.lit(1)).cast("int")
    first = F.slice(F.zip_with(breaks, words, lambda b, w: F.concat(F.coalesce(b, F.lit("")), w)), F.lit(1), upto)
    text = F.when(cut, F.array_join(first, "")).otherwise(F.col("row.text"))
    out = []
    for c in docs.schema.fields:
        value = F.col("row").getField(c.name)
        if c.name == "text":
            value = text
        elif c.name == "n_chars":
            value = F.when(cut, F.length(text).cast(c.dataType)).otherwise(value)
        out.append(value.alias(c.name))
    return found.select(*out)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; see packing.pack."""
    import public_tokenizers

    from .packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
