"""Nested JSON of landmarks and regions as rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAJECTORIES = "map<string,map<string,array<array<double>>>>"
REGIONS = "map<string,struct<Anchor_Index:int,Regions:array<array<int>>>>"


def read_trajectories(df: DataFrame, column: str = "json") -> DataFrame:
    """``{core: {file: [[x, y], ...]}}`` to (core, file, landmark_idx, x, y); points with a missing coordinate are skipped."""
    cores = df.select(F.explode(F.from_json(column, TRAJECTORIES, {"allowNonNumericNumbers": "true"})).alias("core", "files"))
    files = cores.select("core", F.explode("files").alias("file", "points"))
    points = files.select("core", "file", F.posexplode("points").alias("landmark_idx", "p"))
    rows = points.select("core", "file", "landmark_idx", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def write_trajectories(points: DataFrame) -> DataFrame:
    """The rows as one JSON document per core, points in the order of landmark_idx."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("landmark_idx", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    files = points.groupBy("core", "file").agg(ordered.alias("points"))
    cores = files.groupBy("core").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file", "points")))).alias("files"))
    return cores.select(F.to_json(F.create_map("core", "files")).alias("json"))


def read_regions(df: DataFrame, column: str = "json") -> DataFrame:
    """``{core: {Anchor_Index, Regions: [[x, y, w, h], ...]}}`` to (core, anchor, region_idx, x, y, w, h)."""
    cores = df.select(F.explode(F.from_json(column, REGIONS)).alias("core", "r"))
    boxes = cores.select("core", F.col("r.Anchor_Index").alias("anchor"), F.posexplode("r.Regions").alias("region_idx", "b"))
    return boxes.select("core", "anchor", "region_idx", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate("xywh")])
