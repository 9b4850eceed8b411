"""Inputs of the registered queries: cells, planes, keypoints and files derived from the given tables.

Most views have one text for Spark and DuckDB. A view may name earlier ones; ``with_views`` puts them before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "fx_cells": """
SELECT event_id AS cell_id, CAST(floor(event_id / 100) AS BIGINT) % 3 AS core, event_id % 7 AS slice_id,
  event_type AS cell_type, (event_id * 7919) % 1009 AS cx, (event_id * 104729) % 1013 AS cy,
  1 + (event_id * 31) % 400 AS area_px, CAST(floor(event_id / 4) AS BIGINT) AS cluster_id,
  CASE WHEN (event_id * 17) % 5 = 0 THEN 1 ELSE 0 END AS pos_CK, CASE WHEN (event_id * 13) % 4 = 0 THEN 1 ELSE 0 END AS pos_CD3,
  CASE WHEN (event_id * 11) % 3 = 0 THEN 1 ELSE 0 END AS pos_CD163, CASE WHEN (event_id * 7) % 6 = 0 THEN 1 ELSE 0 END AS pos_CD31,
  CASE WHEN (event_id * 5) % 7 = 0 THEN 1 ELSE 0 END AS pos_GAP43, CASE WHEN (event_id * 3) % 8 = 0 THEN 1 ELSE 0 END AS pos_NFP
FROM events""",
    "fx_markers": """
SELECT event_id AS cell_id, CAST(floor(event_id / 100) AS BIGINT) % 3 AS core, event_id % 7 AS slice_id, m.marker AS marker,
  ln(1 + value * (1 + (event_id * m.k) % 11)) AS mean
FROM events CROSS JOIN (SELECT 'CD31' AS marker, 1 AS k UNION ALL SELECT 'GAP43', 2 UNION ALL SELECT 'NFP', 3
  UNION ALL SELECT 'CD3', 4 UNION ALL SELECT 'CD163', 5 UNION ALL SELECT 'CK', 6) m""",
    "fx_map": """
SELECT CAST(floor(event_id / 100) AS BIGINT) % 3 AS core, event_id % 7 AS slice_id, event_id AS cell_id_2d,
  CAST(floor(event_id / 4) AS BIGINT) + 1 AS cell_id_3d
FROM events WHERE event_id % 13 <> 0""",
    "fx_pixels": """
SELECT vec_id, CAST(floor(vec_id / 20) AS BIGINT) AS core, vec_id % 20 AS slice_z,
  CAST(floor(pos / 8) AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x, CAST(v AS DOUBLE) AS v
FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings)""",
    "fx_mask": """
SELECT core, slice_z, y, x, 1 + CAST(floor((y + vec_id % 2) / 2) AS BIGINT) * 5 + CAST(floor((x + vec_id % 3) / 2) AS BIGINT) AS label
FROM fx_pixels WHERE v > 0""",
    "fx_pairs": """
SELECT a.core AS core, a.slice_z AS z, a.y AS y, a.x AS x, a.v AS a, b.v AS b
FROM fx_pixels a JOIN fx_pixels b ON a.core = b.core AND b.slice_z = a.slice_z + 1 AND a.y = b.y AND a.x = b.x""",
    "fx_desc": """
SELECT e.label AS image_id, p.vec_id AS kp_id, CAST(SUM(CASE WHEN p.v <= 0 THEN 0
  WHEN p.y * 8 + p.x = 63 THEN -9223372036854775807 - 1 ELSE CAST(pow(2, p.y * 8 + p.x) AS BIGINT) END) AS BIGINT) AS d
FROM fx_pixels p JOIN embeddings e ON e.vec_id = p.vec_id GROUP BY e.label, p.vec_id""",
    "fx_candidates": """
SELECT p_partkey AS cand_id, p_partkey % 10 AS slide, (p_partkey * 37) % 900 AS cx,
  100 * CAST(floor(p_partkey / 10) AS BIGINT) % 600 + (p_partkey * 13) % 9 AS cy, 40 + p_size % 7 AS w, 42 + p_size % 5 AS h,
  p_size * 150 AS area
FROM part""",
    "fx_regstats": """
SELECT o_orderkey AS reg_id, o_custkey % 30 AS core, o_orderkey % 20 AS slice_z, -0.30E0 - (o_orderkey % 17) / 100.0E0 AS ncc_raw,
  -0.30E0 - (o_orderkey % 23) / 100.0E0 AS ncc_affine, -0.30E0 - (o_orderkey % 31) / 100.0E0 AS ncc_warp, (o_orderkey % 40) AS n_inliers,
  (o_orderkey % 50) AS n_matches, (o_orderkey % 37) - 18 AS rotation_deg, (o_orderkey % 100) / 100.0E0 AS tissue_frac
FROM orders""",
    "fx_areas": """
SELECT o_custkey % 30 AS core, o_orderkey % 20 AS slice_id, CAST(COUNT(*) * 37 + SUM(o_orderkey % 101) AS BIGINT) AS area
FROM orders GROUP BY o_custkey % 30, o_orderkey % 20""",
    "fx_files": """
SELECT DISTINCT concat('240919_3D_BL_TMA_', CAST(l_linenumber AS {text}), '_Core', CAST(l_suppkey % 30 AS {text}), '.ome.tif') AS file
FROM lineitem""",
    "fx_xml": """
SELECT c_custkey AS file_id, concat('<P><Name>', c_name, '</Name><ExposureTime>', CAST(1 + c_custkey % 5 AS {text}),
  '</ExposureTime><IsUnmixedComponent>', CASE WHEN c_custkey % 6 = 0 THEN 'True' ELSE 'False' END, '</IsUnmixedComponent></P>') AS xml
FROM customer""",
}

#: Where DuckDB needs a text of its own.
DUCKDB = VIEWS | {
    "fx_pixels": """
SELECT vec_id, CAST(floor(vec_id / 20) AS BIGINT) AS core, vec_id % 20 AS slice_z,
  CAST(floor((i - 1) / 8) AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, CAST(embedding[i] AS DOUBLE) AS v
FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
}


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """Views that ``text`` names, and those they name, in the order of definition."""
    found = {name for name in views if name in text}
    while more := {n for v in found for n in views if n in views[v]} - found:
        found |= more
    return [name for name in views if name in found]


def oracle(query: str) -> str:
    """``query`` for DuckDB with the views that it names before it."""
    parts = [f"{name} AS ({DUCKDB[name].format(text='VARCHAR')})" for name in _needed(query, DUCKDB)]
    query = query.strip()
    if query[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*parts, query[15:]])
    if query[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*parts, query[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``."""
    text = VIEWS[name].format(text="STRING")
    inputs = {}
    for other in (*[v for v in VIEWS if v != name], *TABLES):
        marked = "".join(f"{{{other}}}" if part == other else part for part in _words(text))
        if marked != text:
            inputs[other] = view(spark, sf_dir, other) if other in VIEWS else table(spark, sf_dir, other)
            text = marked
    return spark.sql(text, **inputs)


def _words(text: str) -> list[str]:
    import re

    return re.split(r"(\b\w+\b)", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
