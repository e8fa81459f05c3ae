"""What the corpus operators share: durable intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \x09-\x0D.
WORD, WORD_BREAK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; gives unused memory back at the end of a task, as Python workers live on."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Has Spark send texts to Python in batches of 8 MB and not 64, unless the session says otherwise.

    Each task holds a batch in both processes, and the JVM keeps the memory for good.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":  # the default
        spark.conf.set(key, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fathom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that saved() has written and discard() has not yet deleted, in order.
_written: list[DataFrame] = []


def saved(df: DataFrame, note: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{note}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    _written.append(out)
    return out


def written_since(at: int = 0) -> list[DataFrame]:
    """What saved() has written after it had written `at` tables that still exist; see discard()."""
    return _written[at:]


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames from saved() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_fathom_path", None)
        if path:
            _written[:] = [x for x in _written if x._fathom_path != path]
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component the least node.

    Alternating large-star and small-star contraction: every step is a min per node and a
    join, so no neighbourhood is ever collected, and the number of edges never grows; a node
with very many edges is a skewed side of the join, which adaptive execution splits. Nodes
    must be comparable (long or string); self-loops and repeated edges are harmless; edges
    with a null end are dropped. An empty input gives an empty result.
    """
    now = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct(),
        "edges",
    )
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = saved(small.distinct(), "edges")
        discard(now)
        now = new
        many = now.groupBy("u").count().where("count > 1").select("u")
        chained = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if many.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    out._fathom_path = now._fathom_path  # so that discard() takes it
    return out
