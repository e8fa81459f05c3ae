"""Continuous ingest: a stream of documents folded into a keyed table, last version first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import latest
from ..operators.table import Table


def ingest(stream: DataFrame, table: str, key: str, order: str, checkpoint: str, once: bool = True, keep: int = 3):
    """Starts folding the stream into the table; returns the running query.

    Each batch keeps the last row of each key, by `order`, and rewrites the buckets that its
    keys fall into. A batch that was committed before isn't folded again. The last `keep`
    states stay readable.
    """
    at = Table(stream.sparkSession, table, key)

    def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        return latest(new if stored is None else stored.unionByName(new, allowMissingColumns=True), key, order)

    def fold(batch: DataFrame, number: int) -> None:
        if at.last_batch() >= number:
            return
        new = latest(batch, key, order).persist()
        try:
            if not new.isEmpty():
                at.change(new, merge, batch=number)
                at.expire(keep)
        finally:
            new.unpersist()

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def generation(spark: SparkSession, table: str, number: int | None = None) -> DataFrame | None:
    """The table as of a batch, or as it is; null if nothing was written."""
    at = Table(spark, table, "")
    return at.read() if number is None else at.as_of(number)
