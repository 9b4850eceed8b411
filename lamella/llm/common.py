"""Helpers shared by the text operators: cutting lineage, checked broadcasts, word splitting and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh temporary one only in local mode, as in tests.

    On a cluster a folder of the driver's machine would be lost to the executors, so there an unset name is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: smaller than a checkpoint for wide rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint when a count proves at most ``most_rows`` rows; otherwise ``df`` as it is, joined by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark send texts to Python in batches of at most ``rows``: whole texts of 10,000 rows are too much for a worker.

    Plans read the setting when they run, so it stays for the session; a smaller one of the caller is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows: what a Python task builds from one of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: Copies of each node's minimum in the joins of a round; a hub's edges are dealt over as many tasks at least.
SALTS = 2


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` as ``(node, component)``, the smallest node naming each.

    Alternating large-star and small-star rounds: every round is a grouped minimum (combined before the shuffle) and an
    equi-join on node and salt. The salt keeps an exchange on both sides of the join, so that a hub with a third of all
    edges is dealt over several tasks and can be split further at run time. Each round is checkpointed. Self-loops and
    null ends are ignored; nodes without an edge do not appear.
    """
    current = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _digest(current)
    while seen[0]:
        current = cut(_small_star(_large_star(current)))
        now = _digest(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    """``edges`` with the minimum ``m`` of their ``node``, by a join whose hot nodes are dealt by ``other``."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [node, "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least, "u", "v").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
