"""Queries over cell tables: projections, joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import aggregate as A
from lamella.operators import joins as J
from lamella.operators import keypoints as K
from lamella.operators import project as P
from lamella.plans.base import query

TYPED = """CASE WHEN pos_CK = 1 THEN 'Tumour' WHEN pos_CD3 = 1 THEN 'T_cell' WHEN pos_CD163 = 1 THEN 'Macrophage'
  WHEN pos_CD31 = 1 THEN 'Endothelial' WHEN pos_GAP43 = 1 OR pos_NFP = 1 THEN 'Neural' ELSE 'Unknown' END"""
LINKED = f"""typed AS (SELECT c.core AS core, c.slice_id AS slice_id, c.cell_id AS cell_id, {TYPED} AS cell_type,
  coalesce(m.cell_id_3d, -1) AS cell_id_3d FROM fx_cells c
  LEFT JOIN fx_map m ON m.core = c.core AND m.slice_id = c.slice_id AND m.cell_id_2d = c.cell_id),
votes AS (SELECT core, cell_id_3d, cell_type, count(*) AS n, min(slice_id * 1000000000 + cell_id) AS f FROM typed WHERE cell_id_3d > 0 GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY core, cell_id_3d ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY core, cell_id_3d) AS total FROM votes),
consensus AS (SELECT core, cell_id_3d, CASE WHEN n::DOUBLE / total < 0.5::DOUBLE THEN 'Ambiguous' ELSE cell_type END AS cell_type,
  round_even(n::DOUBLE / total, 3) AS type_confidence, total::BIGINT AS n_slices_voted FROM ranked WHERE r = 1)"""


def linked(d):
    return J.link_2d_to_3d(P.apply_codebook(d.fx_cells.drop("cell_type")), d.fx_map)


def consensus(d):
    return A.consensus_type(linked(d))


@query(f"""WITH {LINKED}, counts AS (SELECT core, cell_type, count(*) AS n FROM consensus GROUP BY 1, 2)
SELECT core, cell_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY core), 4) AS pct FROM counts""")
def a6_type_distribution(d):
    """How many 3-D cells of each type has each core?"""
    return A.type_distribution(consensus(d))


@query(f"""WITH {LINKED}, counts AS (SELECT core, cell_type, count(*) AS n FROM typed GROUP BY 1, 2)
SELECT core, cell_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY core), 4) AS pct FROM counts""")
def a6_type_distribution_2d(d):
    return A.type_distribution(linked(d))


@query("""SELECT cell_id, cx * 0.5::DOUBLE AS cx_um, area_px * 0.25::DOUBLE AS area_um2, slice_id * 4.5::DOUBLE AS z_um FROM fx_cells""")
def p1_to_microns(d):
    """A pixel of half a micrometre, so that no value lies half-way between two roundings."""
    made = P.to_microns(d.fx_cells.withColumnRenamed("cx", "cx_px"), areas=["area_px"], lengths=["cx_px"], z_index="slice_id", pixel=0.5)
    return made.select("cell_id", "cx_um", "area_um2", "z_um")


@query(f"SELECT cell_id, {TYPED} AS cell_type FROM fx_cells")
def p2_apply_codebook(d):
    return P.apply_codebook(d.fx_cells.drop("cell_type")).select("cell_id", "cell_type")


@query("SELECT cell_id, coalesce(CASE WHEN cell_id % 3 > 0 THEN pos_CK END, 0)::INTEGER AS pos_CK, pos_NFP::INTEGER AS pos_NFP FROM fx_cells")
def p3_normalise_flags(d):
    gaps = d.fx_cells.withColumn("pos_CK", F.when(F.col("cell_id") % 3 > 0, F.col("pos_CK").cast("double")).otherwise(F.when(F.col("cell_id") % 2 == 0, F.lit(float("nan")))))
    return P.normalise_flags(gaps).select("cell_id", "pos_CK", "pos_NFP")


@query(f"WITH {LINKED} SELECT t.core AS core, t.cell_id AS cell_id, t.cell_id_3d AS cell_id_3d, coalesce(c.cell_type, 'Unknown') AS cell_type, coalesce(c.type_confidence, 0::DOUBLE) AS type_confidence FROM typed t LEFT JOIN consensus c USING (core, cell_id_3d)")
def p4_sentinel_fill(d):
    votes = consensus(d).select("core", "cell_id_3d", "cell_type", "type_confidence")
    return P.sentinel_fill(linked(d).select("core", "cell_id", "cell_id_3d").join(votes, ["core", "cell_id_3d"], "left"))


@query("SELECT cell_id, area_px FROM fx_cells WHERE area_px >= 200")
def p5_min_area_filter(d):
    return P.min_area_filter(d.fx_cells).select("cell_id", "area_px")


@query("SELECT vec_id, y, x, round(ln(1 + greatest(v, 0)), 6) AS v FROM fx_pixels")
def p6_log_normalise(d):
    made = P.log_normalise(d.fx_pixels.withColumn("v", F.greatest("v", F.lit(0.0))), "v")
    return made.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query("""SELECT a.core AS core, slice_id, area, CASE WHEN a.core % 5 = 0 THEN 'Damaged' WHEN a.core % 5 = 1 THEN 'Scattered' WHEN a.core % 5 = 4 THEN 'Unknown' ELSE 'Usable' END AS quality
FROM fx_areas a""")
def p7_classify_core(d):
    kind = F.when(F.col("core") % 5 == 0, "Damaged").when(F.col("core") % 5 == 1, "Scattered").otherwise("Usable")
    classes = d.fx_areas.select("core").distinct().filter("core % 5 <> 4").withColumn("quality", kind)
    return P.classify_core(d.fx_areas, classes)


@query("SELECT cell_id, marker, (mean >= 2.5)::INTEGER AS pos FROM fx_markers")
def p8_call_positive(d):
    return P.call_positive(d.fx_markers.withColumn("threshold", F.lit(2.5))).select("cell_id", "marker", "pos")


@query("""WITH tops AS (SELECT core, slice_id, marker, count(*) AS n, quantile_cont(mean, 0.999) AS top FROM fx_markers GROUP BY 1, 2, 3)
SELECT m.cell_id AS cell_id, m.marker AS marker, CASE WHEN n > 100 AND mean > top THEN 0 ELSE (mean >= 2.5)::INTEGER END AS pos
FROM fx_markers m JOIN tops USING (core, slice_id, marker)""")
def p9_reject_top_outliers(d):
    called = P.call_positive(d.fx_markers.withColumn("threshold", F.lit(2.5)))
    return P.reject_top_outliers(called, ["core", "slice_id", "marker"]).select("cell_id", "marker", "pos")


ACCEPT = """gate AS (SELECT *, NOT (ncc_affine > ncc_raw) AS akaze_ok, CASE WHEN ncc_affine > ncc_raw THEN ncc_raw ELSE ncc_affine END AS baseline FROM fx_regstats),
warped AS (SELECT *, tissue_frac >= 0.05::DOUBLE AND (CASE WHEN abs(baseline) > 1e-9 THEN (baseline - ncc_warp) / abs(baseline) ELSE 0 END) >= 0.05::DOUBLE AS warp_ok FROM gate),
accepted AS (SELECT *, CASE WHEN warp_ok THEN 'warp' WHEN akaze_ok THEN 'affine' ELSE 'raw' END AS chosen, CASE WHEN akaze_ok OR warp_ok THEN 'OK' ELSE 'FAILED' END AS status FROM warped)"""


@query(f"WITH {ACCEPT} SELECT reg_id, akaze_ok, warp_ok, round(baseline, 6) AS baseline, chosen, status FROM accepted")
def p10_accept_stage(d):
    return P.accept_stage(d.fx_regstats).select("reg_id", "akaze_ok", "warp_ok", F.round("baseline", 6).alias("baseline"), "chosen", "status")


@query(f"WITH {ACCEPT} SELECT status, count(*) AS n FROM accepted GROUP BY 1")
def a22_status_counts(d):
    return A.status_counts(P.accept_stage(d.fx_regstats))


@query("SELECT reg_id, round(CASE WHEN abs(ncc_raw) > 1e-9 THEN (ncc_raw - ncc_affine) / abs(ncc_raw) * 100 ELSE 0 END, 6) AS gain_pct FROM fx_regstats")
def p11_pct_improvement(d):
    return d.fx_regstats.select("reg_id", F.round(P.pct_improvement(F.col("ncc_raw"), F.col("ncc_affine")), 6).alias("gain_pct"))


@query("SELECT cell_id FROM fx_cells WHERE cx >= 300 AND cx < 700 AND cy >= 300 AND cy < 700 AND slice_id >= 0 AND slice_id < 4")
def p12_roi_filter(d):
    points = d.fx_cells.withColumnsRenamed({"cx": "x", "cy": "y", "slice_id": "z"})
    return P.roi_filter(points, 500, 500, 400, (0, 4)).select("cell_id")


@query("""SELECT cand_id, (CASE WHEN cy < 300 THEN 'T' ELSE 'B' END) || (CASE WHEN cx < 450 THEN 'L' ELSE 'R' END) AS quadrant,
  CASE WHEN cy < 300 THEN cy ELSE cy - 300 END AS local_y, CASE WHEN cx < 450 THEN cx ELSE cx - 450 END AS local_x FROM fx_candidates""")
def p13_quadrant(d):
    return P.quadrant(d.fx_candidates, 600, 900, "cy", "cx").select("cand_id", "quadrant", "local_y", "local_x")


@query("SELECT vec_id, y - 1 AS y, x + 2 AS x, v FROM fx_pixels WHERE y BETWEEN 1 AND 6")
def p14_conform(d):
    """Planes of 8 by 8 cropped to 6 rows and padded to 12 columns."""
    return P.conform(d.fx_pixels.withColumns({"h": F.lit(8), "w": F.lit(8)}), 6, 12).select("vec_id", "y", "x", "v")


@query("SELECT vec_id, y, x, v FROM fx_pixels WHERE y % 4 = 0 AND x % 4 = 0")
def p15_stride_sample(d):
    return P.stride_sample(d.fx_pixels).select("vec_id", "y", "x", "v")


@query("""SELECT cand_id, round(cos(radians(5)) * cx + sin(radians(5)) * cy + (1 - cos(radians(5))) * 450 - sin(radians(5)) * 300, 6) AS new_x,
  round(-sin(radians(5)) * cx + cos(radians(5)) * cy + sin(radians(5)) * 450 + (1 - cos(radians(5))) * 300, 6) AS new_y FROM fx_candidates""")
def p16_affine_points(d):
    m = P.rotation_about(F.lit(5.0), F.lit(450.0), F.lit(300.0))
    out = P.affine_points(d.fx_candidates.withColumn("m", m), F.col("m"), "cx", "cy")
    return out.select("cand_id", F.round("new_x", 6).alias("new_x"), F.round("new_y", 6).alias("new_y"))


def _transform():
    t = F.radians(F.col("rotation_deg").cast("double"))
    s = 1 + F.col("n_inliers") / 400.0
    return P.affine(F.cos(t) * s, -F.sin(t), F.col("n_matches"), F.sin(t) * s, F.cos(t), F.col("n_inliers"))


TRANSFORM = """t AS (SELECT reg_id, cos(radians(rotation_deg)) * (1 + n_inliers / 400.0::DOUBLE) AS a, -sin(radians(rotation_deg)) AS b, n_matches::DOUBLE AS tx,
  sin(radians(rotation_deg)) * (1 + n_inliers / 400.0::DOUBLE) AS c, cos(radians(rotation_deg)) AS d, n_inliers::DOUBLE AS ty FROM fx_regstats)"""


@query(f"""WITH {TRANSFORM} SELECT reg_id, round(a * a + b * c, 6) AS a, round(a * tx + b * ty + tx, 6) AS tx, round(c * b + d * d, 6) AS d,
  round(tx + (1 - a) * 10 - b * 20, 6) AS tile_tx, round(ty - c * 10 + (1 - d) * 20, 6) AS tile_ty FROM t""")
def p17_compose_affine(d):
    m = d.fx_regstats.select("reg_id", _transform().alias("m"))
    both, full = P.compose_all(F.array("m", "m")), P.tile_to_full(F.col("m"), F.lit(10.0), F.lit(20.0))
    out = m.select("reg_id", both.alias("p"), full.alias("f"))
    return out.select("reg_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("a", "tx", "d")], F.round("f.tx", 6).alias("tile_tx"), F.round("f.ty", 6).alias("tile_ty"))


@query(f"""WITH {TRANSFORM} SELECT reg_id, round(degrees(atan2(c - b, a + d)), 6) AS rotation_deg, round((sqrt(a * a + c * c) + sqrt(b * b + d * d)) / 2 * 100 - 100, 6) AS scale_pct,
  round((greatest(sqrt(a * a + c * c), sqrt(b * b + d * d)) / least(sqrt(a * a + c * c), sqrt(b * b + d * d)) - 1) * 100, 6) AS shear_pct FROM t""")
def p18_decompose_affine(d):
    out = P.decompose_affine(d.fx_regstats.select("reg_id", _transform().alias("m")))
    return out.select("reg_id", *[F.round(c, 6).alias(c) for c in ("rotation_deg", "scale_pct", "shear_pct")])


@query(f"""WITH {TRANSFORM}, s AS (SELECT *, least(sqrt(a * a + c * c), 1.08::DOUBLE) AS s0 FROM t)
SELECT reg_id, round(a / sqrt(a * a + c * c) * least(s0, 1.05::DOUBLE), 6) AS a, round(b, 6) AS b, round(c / sqrt(a * a + c * c) * least(s0, 1.05::DOUBLE), 6) AS c, round(d, 6) AS d FROM s""")
def p19_constrain_affine(d):
    out = d.fx_regstats.select("reg_id", P.constrain_affine(_transform(), 0.08, 0.05).alias("m"))
    return out.select("reg_id", *[F.round(f"m.{c}", 6).alias(c) for c in "abcd"])


@query("""SELECT reg_id, CASE WHEN n_matches < 20 THEN 'few_matches' WHEN n_inliers < 6 THEN 'few_inliers' WHEN abs(rotation_deg) > 15 THEN 'rotation' ELSE 'ok' END AS reason,
  n_matches >= 20 AND n_inliers >= 6 AND abs(rotation_deg) <= 15 AS accepted FROM fx_regstats""")
def p20_transform_gate(d):
    return P.transform_gate(d.fx_regstats).select("reg_id", "reason", "accepted")


FIELD = """fld AS (SELECT core, slice_z, y, x, x * 100.0::DOUBLE AS ix, y * 100.0::DOUBLE AS iy, x * 100.0::DOUBLE + v * 1000 AS mx, y * 100.0::DOUBLE - v * 500 AS my, abs(v) * 5 AS conf FROM fx_pixels)"""


def _field(d):
    v = F.col("v")
    return d.fx_pixels.select("core", "slice_z", "y", "x", (F.col("x") * 100.0).alias("identity_x"), (F.col("y") * 100.0).alias("identity_y"), (F.col("x") * 100.0 + v * 1000).alias("map_x"), (F.col("y") * 100.0 - v * 500).alias("map_y"), (F.abs(v) * 5).alias("confidence"))


@query(f"""WITH {FIELD}, sure AS (SELECT f.*, CASE WHEN conf >= 0.5::DOUBLE THEN mx - ix ELSE 0 END AS dx, CASE WHEN conf >= 0.5::DOUBLE THEN my - iy ELSE 0 END AS dy, m.label IS NOT NULL AS tissue
  FROM fld f LEFT JOIN fx_mask m USING (core, slice_z, y, x)),
scaled AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 200 THEN 200 / (sqrt(dx * dx + dy * dy) + 1e-8) ELSE 1 END AS s FROM sure)
SELECT core, slice_z, y, x, round(CASE WHEN tissue THEN ix + dx * s ELSE ix END, 4) AS map_x, round(CASE WHEN tissue THEN iy + dy * s ELSE iy END, 4) AS map_y FROM scaled""")
def p21_regularise_field(d):
    out, _ = P.regularise_field(_field(d), d.fx_mask, ["core", "slice_z"])
    return out.select("core", "slice_z", "y", "x", F.round("map_x", 4).alias("map_x"), F.round("map_y", 4).alias("map_y"))


@query(f"WITH {FIELD} SELECT core, slice_z, sum((conf >= 0.5)::INTEGER)::BIGINT AS n_confident, round(avg((conf >= 0.5)::INTEGER) * 100, 4) AS coverage_pct, round(avg(conf), 6) AS mean_confidence FROM fld GROUP BY 1, 2")
def p21_field_summary(d):
    _, summary = P.regularise_field(_field(d), None, ["core", "slice_z"])
    return summary.select("core", "slice_z", "n_confident", F.round("coverage_pct", 4).alias("coverage_pct"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query(f"WITH {FIELD} SELECT core, slice_z, round(avg(sqrt((mx - ix) ** 2 + (my - iy) ** 2)), 4) AS mean_disp, round(max(sqrt((mx - ix) ** 2 + (my - iy) ** 2)), 4) AS max_disp FROM fld GROUP BY 1, 2")
def a31_field_magnitude(d):
    c = F.col
    out = A.field_magnitude(_field(d), ["core", "slice_z"], c("map_x") - c("identity_x"), c("map_y") - c("identity_y"))
    return out.select("core", "slice_z", F.round("mean_disp", 4).alias("mean_disp"), F.round("max_disp", 4).alias("max_disp"))


@query("SELECT DISTINCT core, cell_id_3d, ('0x' || substr(md5('0-' || cell_id_3d::VARCHAR), 1, 8))::BIGINT % 255 + 1 AS display_id FROM fx_map")
def p22_display_id(d):
    return P.display_id(d.fx_map.select("core", "cell_id_3d").distinct())


BLOBS = "blobs AS (SELECT cand_id, slide, area, 2.0::DOUBLE * (w + h) AS perimeter, (cand_id % 10) / 10.0::DOUBLE AS solidity, w * 10.0::DOUBLE AS peak, cy, cx FROM fx_candidates)"


def _blobs(d):
    c = F.col
    return d.fx_candidates.select("cand_id", "slide", c("area").alias("area_px"), (2.0 * (c("w") + c("h"))).alias("perimeter"), (c("cand_id") % 10 / 10.0).alias("solidity"), (c("w") * 10.0).alias("peak"), "cy", "cx")


@query(f"WITH {BLOBS} SELECT cand_id, round(4 * pi() * area / (perimeter * perimeter), 6) AS circularity FROM blobs WHERE area BETWEEN 500 AND 4000 AND solidity >= 0.3 AND 4 * pi() * area / (perimeter * perimeter) >= 0.5")
def p23_blob_gate(d):
    return P.blob_gate(_blobs(d), 500, 4000, 0.5, 0.3).select("cand_id", F.round("circularity", 6).alias("circularity"))


@query("""WITH b AS (SELECT core, count(*) AS n, avg((ncc_warp > ncc_affine)::INTEGER) AS weak_share, median(abs(rotation_deg)) AS median_drift_px FROM fx_regstats GROUP BY 1)
SELECT core, weak_share > 0.15 AS warn_weak, median_drift_px > 15 AS warn_drift FROM b""")
def p25_qc_alerts(d):
    weak = F.avg((F.col("ncc_warp") > F.col("ncc_affine")).cast("int"))
    summary = d.fx_regstats.groupBy("core").agg(weak.alias("weak_share"), F.median(F.abs("rotation_deg")).alias("median_drift_px"))
    return P.qc_alerts(summary).select("core", "warn_weak", "warn_drift")


@query("SELECT c.core AS core, c.slice_id AS slice_id, c.cell_id AS cell_id, coalesce(m.cell_id_3d, -1) AS cell_id_3d FROM fx_cells c LEFT JOIN fx_map m ON m.core = c.core AND m.slice_id = c.slice_id AND m.cell_id_2d = c.cell_id")
def j1_link_2d_to_3d(d):
    return J.link_2d_to_3d(d.fx_cells, d.fx_map).select("core", "slice_id", "cell_id", "cell_id_3d")


@query(f"WITH {LINKED} SELECT m.core AS core, m.cell_id_3d AS cell_id_3d, coalesce(c.cell_type, 'Unknown') AS cell_type, coalesce(c.type_confidence, 0::DOUBLE) AS type_confidence FROM (SELECT DISTINCT core, cluster_id + 1 AS cell_id_3d FROM fx_cells) m LEFT JOIN consensus c USING (core, cell_id_3d)")
def j2_attach_consensus(d):
    cells = d.fx_cells.select("core", (F.col("cluster_id") + 1).alias("cell_id_3d")).distinct()
    return J.attach_consensus(cells, consensus(d).select("core", "cell_id_3d", "cell_type", "type_confidence"))


@query(f"WITH {LINKED} SELECT core, cell_id_3d, cell_type, type_confidence, n_slices_voted FROM consensus")
def a5_consensus_type(d):
    return consensus(d).drop("composition")


PAIRED = """a AS (SELECT core, slice_id, count(*) AS n FROM fx_cells WHERE area_px < 20 GROUP BY 1, 2), b AS (SELECT core, slice_id, count(*) AS n FROM fx_cells WHERE area_px > 395 GROUP BY 1, 2)"""


@query(f"WITH {PAIRED} SELECT coalesce(a.core, b.core) AS core, coalesce(a.slice_id, b.slice_id) AS slice_id, a.n AS n_2d, b.n AS n_3d, b.n - a.n AS n_delta FROM a FULL JOIN b ON a.core = b.core AND a.slice_id = b.slice_id")
def j3_compare_pairs(d):
    count = lambda where: d.fx_cells.filter(where).groupBy("core", "slice_id").agg(F.count("*").alias("n"))
    return J.compare_pairs(count("area_px < 20"), count("area_px > 395"), ["core", "slice_id"], ["n"])


@query(f"WITH {PAIRED} SELECT core, slice_id, a.n AS n_2d, b.n AS n_3d, b.n - a.n AS n_delta FROM a JOIN b USING (core, slice_id)")
def j3_complete_pairs(d):
    count = lambda where: d.fx_cells.filter(where).groupBy("core", "slice_id").agg(F.count("*").alias("n"))
    return J.compare_pairs(count("area_px < 20"), count("area_px > 395"), ["core", "slice_id"], ["n"], complete=True)


@query("SELECT core, slice_id, cell_type, count(*) AS n FROM fx_cells GROUP BY 1, 2, 3 HAVING count(*) >= 10")
def a11_valid_types(d):
    return A.valid_types(d.fx_cells, keys=["core", "slice_id"])


@query("""SELECT core, cluster_id AS cell_id_3d, min(slice_id) AS z_min, max(slice_id) AS z_max, max(slice_id) - min(slice_id) + 1 AS z_span_slices, count(*) AS n_2d_segments,
  sum(area_px)::BIGINT AS volume_px, round_even(sum(cx * area_px)::DOUBLE / sum(area_px), 2) AS centroid_x_px, round_even(sum(area_px) * (0.4961::DOUBLE * 0.4961::DOUBLE * 4.5::DOUBLE), 3) AS volume_um3
FROM fx_cells GROUP BY 1, 2 HAVING max(slice_id) - min(slice_id) + 1 >= 2 AND max(area_px) >= 10""")
def a4_cell3d_features(d):
    members = d.fx_cells.select("core", F.col("cluster_id").alias("cell_id_3d"), F.col("slice_id").alias("z"), "slice_id", "area_px", F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"))
    out = A.cell3d_features(members, min_slices=2)
    return out.select("core", "cell_id_3d", "z_min", "z_max", "z_span_slices", "n_2d_segments", "volume_px", "centroid_x_px", "volume_um3")


SCORES = "scores AS (SELECT core, slice_z, -ncc_raw AS jaccard, -ncc_affine AS ncc, -ncc_warp AS nmi FROM fx_regstats)"


def _scores(d):
    return d.fx_regstats.select("core", "slice_z", (-F.col("ncc_raw")).alias("jaccard"), (-F.col("ncc_affine")).alias("ncc"), (-F.col("ncc_warp")).alias("nmi"))


@query(f"WITH {SCORES} SELECT core, round(avg(jaccard), 6) AS jaccard, round(avg(ncc), 6) AS ncc, round(avg(nmi), 6) AS nmi, round(0.3::DOUBLE * avg(jaccard) + 0.3::DOUBLE * avg(ncc) + 0.4::DOUBLE * avg(nmi), 6) AS score FROM scores GROUP BY 1")
def a12_rank_cores(d):
    out = A.rank_cores(_scores(d), A.SCORE_WEIGHTS)
    return out.select("core", *[F.round(c, 6).alias(c) for c in ("jaccard", "ncc", "nmi", "score")])


STAGES = """staged AS (SELECT reg_id % 3 AS stage, ncc_raw AS ncc, ncc_warp * ncc_warp AS mse FROM fx_regstats),
longed AS (SELECT stage, 'ncc' AS metric, ncc AS value FROM staged UNION ALL SELECT stage, 'mse', mse FROM staged)"""


def _stages(d):
    return d.fx_regstats.select((F.col("reg_id") % 3).alias("stage"), F.col("ncc_raw").alias("ncc"), (F.col("ncc_warp") * F.col("ncc_warp")).alias("mse"))


@query(f"WITH {STAGES} SELECT stage, metric, count(*) AS n_pairs, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std FROM longed GROUP BY 1, 2")
def a13_stage_summary(d):
    return A.stage_summary(_stages(d), ["ncc", "mse"])


@query(f"""WITH {STAGES}, means AS (SELECT metric, stage, avg(value) AS m FROM longed GROUP BY 1, 2),
w AS (SELECT *, lag(m) OVER (PARTITION BY metric ORDER BY stage) AS p, first_value(m) OVER (PARTITION BY metric ORDER BY stage) AS f, CASE WHEN metric = 'mse' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM means)
SELECT metric, stage, round(m, 5) AS mean, round(m - p, 5) AS delta, round(s * (m - p) / (abs(p) + 1e-12) * 100, 2) AS gain_pct, round(s * (m - f) / (abs(f) + 1e-12) * 100, 2) AS gain_vs_first_pct FROM w""")
def a14_stage_delta(d):
    return A.stage_delta(_stages(d), ["ncc", "mse"])


@query("SELECT (reg_id % 4)::VARCHAR AS metric, round_even(avg(ncc_raw * 100), 2) AS mean_gain_pct FROM fx_regstats GROUP BY 1")
def a15_cross_core_gain(d):
    return A.cross_core_gain(d.fx_regstats.select((F.col("reg_id") % 4).cast("string").alias("metric"), (F.col("ncc_raw") * 100).alias("gain_pct")))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY slice_id) AS r FROM fx_areas),
s AS (SELECT core, max(CASE WHEN r = 1 THEN area END) AS first_area, avg(CASE WHEN r > 1 THEN area END) AS rest_mean, count(*) AS n_slices FROM o GROUP BY 1)
SELECT core, first_area, round(rest_mean, 6) AS rest_mean, n_slices, round(first_area / rest_mean, 6) AS ratio, first_area / rest_mean < 0.75 AS reduced FROM s WHERE n_slices >= 2""")
def a17_first_slice_shrinkage(d):
    return A.first_slice_shrinkage(d.fx_areas).select("core", "first_area", F.round("rest_mean", 6).alias("rest_mean"), "n_slices", F.round("ratio", 6).alias("ratio"), "reduced")


@query("""WITH f AS (SELECT core, area, 'slice_' || lpad(slice_id::VARCHAR, 3, '0') AS file FROM fx_areas WHERE area > 1000), r AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY area, file) AS r FROM f)
SELECT core, file AS anchor, area FROM r WHERE r = 1""")
def a18_anchor_slice(d):
    named = d.fx_areas.withColumn("file", F.concat(F.lit("slice_"), F.lpad(F.col("slice_id").cast("string"), 3, "0")))
    return A.anchor_slice(named)


@query("""WITH s AS (SELECT slide, h, w, count(*) AS n FROM fx_candidates GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY n DESC, h * w DESC, h DESC) AS r, sum(n) OVER (PARTITION BY slide) AS t FROM s)
SELECT slide, h, w, n AS n_copied, (t - n)::BIGINT AS n_conformed, t::BIGINT AS n_total FROM r WHERE r = 1""")
def a19_canonical_shape(d):
    return A.canonical_shape(d.fx_candidates, ["slide"])


@query("""WITH s AS (SELECT core, cell_id_3d, count(DISTINCT slice_id) > 1 AS multi FROM fx_map GROUP BY 1, 2)
SELECT core, slice_id, count(*) AS n_cells, sum(multi::INTEGER)::BIGINT AS n_multi, (count(*) - sum(multi::INTEGER))::BIGINT AS n_single FROM fx_map JOIN s USING (core, cell_id_3d) GROUP BY 1, 2""")
def a20_multi_slice_cells(d):
    return A.multi_slice_cells(d.fx_map)


@query("""WITH l AS (SELECT core, slice_id, marker, pos FROM (UNPIVOT fx_cells ON pos_CK, pos_CD3, pos_CD163, pos_CD31, pos_GAP43, pos_NFP INTO NAME marker VALUE pos))
SELECT core, slice_id, substr(marker, 5) AS marker, sum(pos)::BIGINT AS n_pos, count(*) AS n_cells, round(avg(pos) * 100, 4) AS pct_pos FROM l GROUP BY 1, 2, 3""")
def a21_positivity_summary(d):
    return A.positivity_summary(P.unpivot_markers(d.fx_cells, ["core", "slice_id", "cell_id"]))


@query("SELECT core, " + ", ".join(f"round(avg(CASE WHEN slice_z = {i} THEN ncc_raw END), 6) AS \"{i}\"" for i in range(5)) + " FROM fx_regstats GROUP BY 1")
def a24_pair_heatmap(d):
    named = d.fx_regstats.withColumn("pair", F.concat("slice_z", F.lit("-"), F.col("slice_z") + 1))
    out = A.pair_heatmap(named, "ncc_raw", indices=range(5))
    return out.select("core", *[F.round(str(i), 6).alias(str(i)) for i in range(5)])


@query("SELECT core, count(ncc_raw) AS n, round(min(ncc_raw), 6) AS low, round(quantile_cont(ncc_raw, 0.25), 6) AS q1, round(median(ncc_raw), 6) AS median, round(quantile_cont(ncc_raw, 0.75), 6) AS q3, round(max(ncc_raw), 6) AS high FROM fx_regstats GROUP BY 1")
def a25_box_summary(d):
    out = A.box_summary(d.fx_regstats, "ncc_raw", ["core"])
    return out.select("core", "n", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("""WITH g AS (SELECT core % 5 AS grp, slice_z AS method, CASE WHEN bool_or(slice_z % 7 = 3) THEN NULL ELSE avg(n_inliers) END AS value FROM fx_regstats GROUP BY 1, 2),
r AS (SELECT grp, method, row_number() OVER (PARTITION BY grp ORDER BY value DESC, method DESC) AS r FROM g WHERE value IS NOT NULL)
SELECT g.grp AS grp, g.method AS method, round(value, 6) AS value, coalesce(r.r = 1, false) AS is_best FROM g LEFT JOIN r ON r.grp = g.grp AND r.method = g.method""")
def a27_method_grid(d):
    failed = F.max((F.col("slice_z") % 7 == 3).cast("int")) == 1
    grid = d.fx_regstats.groupBy((F.col("core") % 5).alias("grp"), F.col("slice_z").alias("method")).agg(F.when(~failed, F.avg("n_inliers")).alias("value"))
    return A.method_grid(grid, ["grp"], "method", "value").select("grp", "method", F.round("value", 6).alias("value"), "is_best")


LAYOUT = """top AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY area DESC, cand_id) AS k FROM fx_candidates), chosen AS (SELECT * FROM top WHERE k <= 30),
hs AS (SELECT slide, median(h) AS mh, median(w) AS mw FROM chosen GROUP BY 1)"""


@query(f"""WITH {LAYOUT}, j AS (SELECT c.*, (cy - lag(cy) OVER (PARTITION BY c.slide ORDER BY cy, cand_id) > mh * 0.5)::INTEGER AS j FROM chosen c JOIN hs ON hs.slide = c.slide),
g AS (SELECT *, sum(coalesce(j, 0)) OVER (PARTITION BY slide ORDER BY cy, cand_id ROWS UNBOUNDED PRECEDING) AS grid_row FROM j)
SELECT slide, cand_id, grid_row::INTEGER AS grid_row, (row_number() OVER (PARTITION BY slide, grid_row ORDER BY cx, cand_id) - 1)::INTEGER AS grid_col, (row_number() OVER (PARTITION BY slide ORDER BY grid_row, cx, cand_id))::INTEGER AS core_no FROM g""")
def w1_grid_layout(d):
    return K.grid_layout(d.fx_candidates).select("slide", "cand_id", "grid_row", "grid_col", "core_no")


@query(f"WITH {LAYOUT} SELECT slide, floor(greatest(mh, mw) * 1.35::DOUBLE)::BIGINT AS box FROM hs")
def w2_standard_box(d):
    return K.standard_box(d.fx_candidates)


@query("SELECT cand_id, area FROM fx_candidates WHERE area >= 2000 AND w::DOUBLE / h BETWEEN 0.3 AND 3.0")
def w3_candidate_filter(d):
    return K.candidate_filter(d.fx_candidates).select("cand_id", "area")


@query("WITH r AS (SELECT core, slice_id, cell_id, row_number() OVER (PARTITION BY core, slice_id ORDER BY md5('42-' || cell_id::VARCHAR), cell_id) AS r FROM fx_cells) SELECT core, slice_id, cell_id FROM r WHERE r <= 20")
def w4_sample_n(d):
    return K.sample_n(d.fx_cells, 20, 42, ["core", "slice_id"]).select("core", "slice_id", "cell_id")


@query("""WITH p AS (SELECT a.slide AS slide, degrees(atan2(b.cy - a.cy, b.cx - a.cx)) AS ang FROM fx_candidates a JOIN fx_candidates b ON a.slide = b.slide AND a.cand_id <> b.cand_id
  WHERE b.cx - a.cx >= 0 AND abs(b.cy - a.cy) <= abs(b.cx - a.cx) AND sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2) < 300 AND (b.cx > a.cx OR a.cand_id < b.cand_id)),
m AS (SELECT slide, median(ang) AS a FROM p GROUP BY 1)
SELECT s.slide AS slide, round(CASE WHEN abs(coalesce(a, 0)) > 12 THEN 0 ELSE coalesce(a, 0) END, 6) AS tilt_deg FROM (SELECT DISTINCT slide FROM fx_candidates) s LEFT JOIN m ON m.slide = s.slide""")
def j14_row_tilt(d):
    return J.row_tilt(d.fx_candidates).select("slide", F.round("tilt_deg", 6).alias("tilt_deg"))


@query("SELECT cell_id, cell_type FROM fx_cells WHERE cell_type IN ('view', 'error')")
def j13_keep_types(d):
    return J.keep_types(d.fx_cells, ["view", "error"]).select("cell_id", "cell_type")


@query("""SELECT cell_type, count(*) AS n FROM (SELECT DISTINCT cell_type FROM fx_cells WHERE core = 0 UNION SELECT DISTINCT cell_type FROM fx_cells WHERE core = 1) GROUP BY 1""")
def s11_union_of_types(d):
    kinds = lambda c: d.fx_cells.filter(F.col("core") == c).select("cell_type")
    return kinds(0).union(kinds(1)).distinct().groupBy("cell_type").agg(F.count("*").alias("n"))
