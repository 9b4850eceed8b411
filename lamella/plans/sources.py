"""Queries over catalogues and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamella.operators import joins as J
from lamella.operators import project as P
from lamella.operators.lineage import checkpoint_folder
from lamella.plans.base import query
from lamella.sources import catalog as C
from lamella.sources import landmarks as L
from lamella.sources import tables as TB

FILTERS = "SELECT core, CASE WHEN core % 3 = 0 THEN '0-3, 7' WHEN core % 3 = 1 THEN '1-15' ELSE '5' END AS ranges FROM (SELECT DISTINCT s_suppkey % 1000 AS core FROM supplier) WHERE core % 5 <> 4"
ALLOWED = f"flt AS ({FILTERS}), allowed AS (SELECT core, unnest(CASE ranges WHEN '0-3, 7' THEN [0, 1, 2, 3, 7] WHEN '1-15' THEN range(1, 16) ELSE [5] END)::INTEGER AS position FROM flt)"


def filters(d):
    """Cores of every fifth number have no entry, so all their slices stay."""
    core = F.col("core")
    ranges = F.when(core % 3 == 0, "0-3, 7").when(core % 3 == 1, "1-15").otherwise("5")
    return d.supplier.select((F.col("s_suppkey") % 1000).alias("core")).distinct().filter(core % 5 != 4).select("core", ranges.alias("ranges"))


@query(f"WITH {ALLOWED} SELECT core, position FROM allowed")
def s6_expand_slice_filter(d):
    return C.expand_slice_filter(filters(d))


@query(f"WITH {ALLOWED} SELECT a.core AS core, a.slice_id AS slice_id, a.area AS area FROM fx_areas a WHERE a.core NOT IN (SELECT core FROM flt) OR EXISTS (SELECT 1 FROM allowed w WHERE w.core = a.core AND w.position = a.slice_id)")
def j13_keep_slices(d):
    rows = d.fx_areas.withColumn("position", F.col("slice_id"))
    return J.keep_slices(rows, C.expand_slice_filter(filters(d))).select("core", "slice_id", "area")


@query("""WITH f AS (SELECT file, regexp_extract(file, '_Core([0-9]+)', 1) AS core, coalesce(try_cast(regexp_extract(file, 'TMA_([0-9]+)_', 1) AS INTEGER), -1) AS slice_id FROM fx_files)
SELECT file, core, slice_id, (row_number() OVER (PARTITION BY core ORDER BY slice_id, file) - 1)::INTEGER AS z FROM f""")
def s7_slice_catalog(d):
    named = d.fx_files.withColumn("core", F.regexp_extract("file", r"_Core(\d+)", 1))
    return C.slice_catalog(named)


@query("""SELECT file_id, 0::INTEGER AS channel_index, regexp_extract(xml, '<Name>([^<]*)', 1) AS "Name", regexp_extract(xml, '<ExposureTime>([^<]*)', 1) AS "ExposureTime", regexp_extract(xml, '<IsUnmixedComponent>([^<]*)', 1) AS "IsUnmixedComponent" FROM fx_xml""")
def s8_channel_metadata(d):
    out = C.channel_metadata(d.fx_xml)
    return out.select("file_id", "channel_index", "Name", "ExposureTime", "IsUnmixedComponent")


@query("""WITH c AS (SELECT c_nationkey AS file_id, c_custkey % 2 AS ch, max((c_custkey % 6 = 0)::INTEGER) AS unmixed, max((1 + c_custkey % 5)::DOUBLE) AS e FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 < 3 GROUP BY 1, 2),
p AS (SELECT file_id, max(unmixed) AS unmixed, max(CASE WHEN ch = 0 THEN e END) AS ck, max(CASE WHEN ch = 1 THEN e END) AS af FROM c GROUP BY 1)
SELECT file_id, round(ck / af, 6) AS exposure_ratio, CASE WHEN unmixed = 1 THEN 'do_not_subtract' WHEN ck / af IS NULL THEN 'none' WHEN abs(ck / af - 1) < 0.01 THEN 'subtract' ELSE 'subtract_scaled' END AS advice FROM p""")
def p24_exposure_advice(d):
    channels = C.channel_metadata(d.fx_xml).drop("channel_index").join(d.customer.withColumnRenamed("c_custkey", "file_id"), "file_id")
    channels = channels.filter("file_id % 2 = 0 OR file_id % 7 < 3").select(F.col("c_nationkey").alias("file_id"), (F.col("file_id") % 2).alias("channel_index"), "ExposureTime", "IsUnmixedComponent")
    return P.exposure_advice(channels, 0, 1).withColumn("exposure_ratio", F.round("exposure_ratio", 6))


POSITIONS = "pos AS (SELECT core, slice_id, (row_number() OVER (PARTITION BY core ORDER BY slice_id) - 1)::BIGINT AS position FROM fx_areas)"


@query(f"""WITH {POSITIONS}, known AS (SELECT core, slice_id, position AS z FROM pos WHERE NOT (position = 2 OR (core % 2 = 0 AND position = 5))),
n AS (SELECT p.core AS core, count(*) AS n FROM pos p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.core = p.core AND k.slice_id = p.slice_id) GROUP BY 1)
SELECT core, slice_id, position, position AS z FROM pos""")
def j5_map_slice_to_z(d):
    """Two slices without a z in even cores, one in odd ones."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("core").orderBy("slice_id")
    files = d.fx_areas.select("core", "slice_id", (F.row_number().over(order) - 1).cast("long").alias("position"))
    stats = files.filter("NOT (position = 2 OR (core % 2 = 0 AND position = 5))").select("core", "slice_id", F.col("position").alias("z"))
    return J.map_slice_to_z(files, stats).select("core", "slice_id", "position", "z")


@query("""WITH k AS (SELECT n_nationkey AS position, 'stack_TMA_' || (n_nationkey % 8)::VARCHAR || '_Core' || n_nationkey::VARCHAR || '.ome.tif_x' AS key, n_nationkey * 1.5::DOUBLE AS tre FROM nation),
f AS (SELECT DISTINCT substr(file, 14) AS file FROM fx_files), h AS (SELECT file, tre, row_number() OVER (PARTITION BY file ORDER BY position, key) AS r FROM f JOIN k ON contains(key, file))
SELECT f.file AS file, tre AS tre_px FROM f LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.file = f.file""")
def j6_attach_tre(d):
    key = F.col("n_nationkey")
    name = F.concat(F.lit("stack_TMA_"), (key % 8).cast("string"), F.lit("_Core"), key.cast("string"), F.lit(".ome.tif_x"))
    stats = d.nation.select(key.alias("position"), name.alias("key"), (key * 1.5).alias("tre_px"))
    images = d.fx_files.select(F.expr("substring(file, 14)").alias("file")).distinct()
    return J.attach_tre(images, stats)


@query("SELECT core::VARCHAR AS core, 's' || slice_id::VARCHAR AS file, cluster_id::INTEGER AS landmark_idx, min(cx)::DOUBLE AS x, min(cy)::DOUBLE AS y FROM fx_cells GROUP BY 1, 2, 3")
def s4_read_trajectories(d):
    """Landmarks written as JSON per core and read again: places in the document are the landmark numbers."""
    import pyspark.sql.types as T

    marks = d.fx_cells.groupBy("core", "slice_id", "cluster_id").agg(F.min("cx").cast("double").alias("x"), F.min("cy").cast("double").alias("y"))
    named = marks.select(F.col("core").cast("string").alias("core"), F.concat(F.lit("s"), "slice_id").alias("file"), F.col("cluster_id").cast(T.IntegerType()).alias("landmark_idx"), "x", "y")
    last = named.groupBy("core", "file").agg(F.max("landmark_idx").alias("last"))
    grid = last.select("core", "file", F.explode(F.sequence(F.lit(0), "last")).alias("landmark_idx"))
    dense = grid.join(named, ["core", "file", "landmark_idx"], "left").fillna({"x": float("nan"), "y": float("nan")})
    return L.read_trajectories(L.write_trajectories(dense))


@query("SELECT slide::VARCHAR AS core, min(cand_id)::INTEGER AS anchor, count(*) AS n_regions, sum(cx)::BIGINT AS sum_x, sum(h)::BIGINT AS sum_h FROM fx_candidates GROUP BY 1")
def s5_read_regions(d):
    box = F.sort_array(F.collect_list(F.array("cx", "cy", "w", "h")))
    docs = d.fx_candidates.groupBy("slide").agg(F.to_json(F.create_map(F.first(F.col("slide").cast("string")), F.struct(F.min("cand_id").alias("Anchor_Index"), box.alias("Regions")))).alias("json"))
    rows = L.read_regions(docs)
    return rows.groupBy("core").agg(F.min("anchor").alias("anchor"), F.count("*").alias("n_regions"), F.sum("x").alias("sum_x"), F.sum("h").alias("sum_h"))


def _folder(d, name: str) -> str:
    """A new folder in the shared place of checkpoints."""
    return f"{checkpoint_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


CELL_TABLE = "cell_id bigint, core bigint, slice_id bigint, cell_type string, area_px bigint"


@query("SELECT cell_id, core, slice_id, cell_type, area_px FROM fx_cells")
def s1_read_table(d):
    """Cells written as CSV and read again under a schema."""
    path = _folder(d, "cells-csv")
    TB.write_table(d.fx_cells.select("area_px", "cell_type", "slice_id", "core", "cell_id", "cx"), path, format="csv")
    return TB.read_table(d.spark, path, CELL_TABLE, ["cell_id", "cell_type"])


@query("SELECT core::VARCHAR AS \"Core\", cell_id::VARCHAR AS cell_id, CASE WHEN core <> 1 THEN cell_type END AS cell_type, CASE WHEN core <> 0 THEN area_px::VARCHAR END AS area_px FROM fx_cells")
def s2_read_per_core(d):
    """A folder of CSV per core, whose files differ in their columns."""
    path = _folder(d, "per-core")
    for core, columns in ((0, ["cell_id", "cell_type"]), (1, ["area_px", "cell_id"]), (2, ["cell_type", "cell_id", "area_px"])):
        d.fx_cells.filter(F.col("core") == core).select(*columns).write.option("header", True).csv(f"{path}/{core}")
    return TB.read_per_core(d.spark, f"{path}/*/*.csv").select("Core", "cell_id", "cell_type", "area_px")


@query("SELECT cell_id, core::INTEGER AS core, slice_id::INTEGER AS slice_id, CASE WHEN core = 1 AND slice_id < 4 THEN upper(cell_type) ELSE cell_type END AS cell_type FROM fx_cells")
def s3_write_table(d):
    """Cells written to a folder per core and slice; some slices of a core are written again, twice, and the others stay."""
    path, cells = _folder(d, "cells"), d.fx_cells.select("cell_id", "core", "slice_id", "cell_type")
    TB.write_table(cells, path, ["core", "slice_id"])
    again = cells.filter("core = 1 AND slice_id < 4").withColumn("cell_type", F.upper("cell_type"))
    for _ in range(2):
        TB.write_table(again, path, ["core", "slice_id"])
    return d.spark.read.parquet(path).select("cell_id", "core", "slice_id", "cell_type")


@query("SELECT cell_id, core, slice_id, CASE WHEN core = 1 THEN upper(cell_type) ELSE cell_type END AS cell_type, CASE WHEN core = 1 THEN area_px END AS area_px FROM fx_cells WHERE core <> 2")
def s3_published(d):
    """Cells published by core; core 1 is measured again with one more column, core 2 has no cells any more."""
    path, cells = _folder(d, "published"), d.fx_cells.select("cell_id", "core", "slice_id", "cell_type", "area_px")
    TB.publish(cells.drop("area_px"), path)
    TB.publish(cells.filter("core = 2").drop("area_px"), path)
    TB.publish(cells.filter("core = 1").withColumn("cell_type", F.upper("cell_type")), path, groups=d.spark.range(2, 3).toDF("core"))
    return TB.published(d.spark, path)


@query("""WITH l AS (SELECT o_custkey % 30 AS core, max(o_orderkey) AS n FROM orders GROUP BY 1)
SELECT core::VARCHAR AS core, CASE WHEN core % 5 <> 0 THEN n END AS n_cells, CASE WHEN core % 5 <> 0 THEN 'OK' ELSE 'NO_COUNT' END AS status FROM l""")
def s10_scan_run_logs(d):
    """A log per core whose last count stands; every fifth run reports none."""
    path = _folder(d, "logs")
    line = F.concat(F.when(F.col("core") % 5 == 0, "step ").otherwise("Final 3D cell count: "), F.col("o_orderkey").cast("string"))
    rows = d.orders.select((F.col("o_custkey") % 30).alias("core"), "o_orderkey").withColumn("value", line)
    rows.repartition("core").sortWithinPartitions("core", "o_orderkey").select("core", "value").write.partitionBy("core").text(path)
    return C.scan_run_logs(d.spark, f"{path}/*/*.txt", file=r"core=(\d+)/")
