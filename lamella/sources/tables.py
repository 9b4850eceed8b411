"""Scans and sinks of the tables that sections of the analysis exchange."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.scalars import nan_to_null, require


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header under an explicit schema; NaN and empty fields are NULL, missing columns an error.

    Columns are matched by name: a file may order them otherwise or carry others.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).csv(path)
    require(header, required)
    names = [f for f in typed if f.name in header.columns]
    return nan_to_null(header.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in names]))


def read_per_core(spark: SparkSession, paths: str | Sequence[str], pattern: str = r"/([^/]+)/[^/]+\.csv$", core: str = "Core") -> DataFrame:
    """CSV of a directory per core, paths or a glob, the directory's name as a column; files may differ in their columns.

    Files are read together by header, so the plan grows with the number of different headers and not of files; columns
    that a file lacks are NULL.
    """
    paths = [paths] if isinstance(paths, str) else [*paths]
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = [spark.read.option("header", True).csv(r["files"]).withColumn(core, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)) for r in heads.orderBy("head").collect()]  # names of files
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str, keys: Sequence[str] = ("core",), format: str = "parquet", replace: str = "groups") -> None:
    """Parquet or CSV in a directory per key; CSV has arrays and maps as text.

    Groups that ``df`` has rows of replace what was stored of them, and all others stay: a core that is measured again
    leaves the other cores alone, and writing it twice is writing it once. ``replace="all"`` replaces the whole table. Files
    are staged and moved into place at the end; a reader who must not meet them halfway uses ``publish`` and ``published``.
    """
    if replace not in ("groups", "all"):
        raise ValueError(f"replace is groups or all, not {replace}")
    if format == "csv":
        nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
        df = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    own = [k for k in keys if k in df.columns]
    mode = "dynamic" if own and replace == "groups" else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).option("header", True).partitionBy(*own).format(format).save(path)


#: Runs whose folders a reader names in its scan; of more it lists all folders and leaves the choice to the join.
NAMED_RUNS = 1000


def publish(df: DataFrame, path: str, keys: Sequence[str] = ("core",), groups: DataFrame | None = None) -> str:
    """Store the groups of ``df`` as one run and make it current at once; returns the run's name.

    The rows go to a folder of their own below ``path``. Only when all are written does one small file in the manifest name
    the run for each of its groups, so a reader sees a group's old rows or its new ones and never part of them, and a run
    that fails or is lost changes nothing. Of two runs of a group the later one counts. ``groups(keys)`` names groups to
    replace even if ``df`` has no row of them.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*keys).parquet(f"{path}/runs/run={run}")
    own = spark.read.schema(df.schema).parquet(f"{path}/runs/run={run}").select(*keys)
    own = (own if groups is None else own.unionByName(groups.select(*[F.col(k).cast(df.schema[k].dataType) for k in keys]))).distinct()
    known = _manifest(spark, path)
    at = 1 if known is None else (known.agg(F.max("at")).first()[0] or 0) + 1
    named = own.select(*keys, F.lit(run).alias("run"), F.lit(at).cast("long").alias("at"), F.lit(df.schema.json()).alias("columns"))
    named.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows ``(keys, run, at, columns)`` of all runs; None before the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(f"{path}/manifest") if there else None


def _current(manifest: DataFrame) -> DataFrame:
    """The run that counts for each group."""
    keys = [c for c in manifest.columns if c not in ("run", "at", "columns")]
    return manifest.groupBy(*keys).agg(F.max_by("run", F.struct("at", "run")).alias("run"))


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of every group of a table that ``publish`` has stored, under the columns and types of the last run.

    Groups are matched by run and key, so partitions of replaced runs are not read. Columns that an older run lacks are NULL.
    """
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"nothing is published in {path}")
    columns = T.StructType.fromJson(json.loads(manifest.agg(F.max_by("columns", F.struct("at", "run"))).first()[0]))
    current = _current(manifest)
    keys = [c for c in current.columns if c != "run"]
    rows = spark.read.option("basePath", f"{path}/runs").schema(T.StructType([*columns, T.StructField("run", T.StringType())])).parquet(f"{path}/runs")
    runs = [r["run"] for r in current.select("run").distinct().limit(NAMED_RUNS + 1).collect()]
    if len(runs) <= NAMED_RUNS:
        rows = rows.filter(F.col("run").isin(runs))
    matched = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(current[k]) for k in ("run", *keys)])
    return rows.join(current, matched, "left_semi").select(*columns.names)


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the folders of runs that count for no group any more, and say how many; for times when nobody reads or writes."""
    manifest = _manifest(spark, path)
    old = manifest.select("run").distinct().join(_current(manifest).select("run").distinct(), "run", "left_anti")
    gone = 0
    for r in old.toLocalIterator():  # one name at a time
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs/run={r['run']}")
        gone += folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
