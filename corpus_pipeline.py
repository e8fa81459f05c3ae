"""The corpus pipeline: toxicity, quality rules, near-dedup, mixing to weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import common, stages

STAGES = [
    ("toxicity", stages.toxicity),
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]
#: A learned classifier, a learned decision list, sketches and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on its predecessor's written result.

    A stage's other tables, and its predecessor's result, are deleted once its own is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = len(common.written_since())
        new = stages.written(stage(spark, docs, sf_dir), name)
        common.discard(docs, *[x for x in common.written_since(before) if x is not new])
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
