"""Cutting the lineage of iterative jobs in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows of groups are broadcast to the groups' cells; more meet them by shuffle.
BROADCAST_GROUPS = 50_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the folder of ``spark.checkpoint.dir``, so that lost executors cost no rounds.

    A temporary folder is set only where that is unset and Spark runs on one machine, as in tests; on a cluster, where
    executors do not see the driver's folders, an unset name is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint when a count proves at most ``most_rows`` rows; otherwise ``df`` as it is, joined by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
