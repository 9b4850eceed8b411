"""Queries over pixel planes and label masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import aggregate as A
from lamella.operators import imagepair as M
from lamella.operators import joins as J
from lamella.operators import runs as R
from lamella.operators import threshold as T
from lamella.plans.base import query

PLANE = ["core", "slice_z"]


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def pairs(d):
    return J.adjacent_pairs(d.fx_pixels)


@query("SELECT core, z, y, x, a, b FROM fx_pairs")
def j12_adjacent_pairs(d):
    return pairs(d)


@query("SELECT core, slice_z, label, count(*) AS area_px, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x FROM fx_mask GROUP BY 1, 2, 3")
def a1_label_stats(d):
    return rounded(A.label_stats(d.fx_mask), "centroid_y", "centroid_x")


@query(like="a1_label_stats")
def a1_run_stats(d):
    """The same from runs."""
    return rounded(R.run_stats(R.runs_of_pixels(d.fx_mask)), "centroid_y", "centroid_x")


@query("SELECT m.core AS core, m.slice_z AS slice_z, label, round(avg(ln(1 + greatest(v, 0))), 6) AS mean FROM fx_mask m JOIN fx_pixels p ON m.core = p.core AND m.slice_z = p.slice_z AND m.y = p.y AND m.x = p.x GROUP BY 1, 2, 3")
def a2_label_means(d):
    return rounded(A.label_means(d.fx_mask, d.fx_pixels), "mean")


@query(like="a2_label_means")
def a2_run_means(d):
    """The same from runs and image rows."""
    return rounded(R.run_means(R.runs_of_pixels(d.fx_mask), R.rows_of_pixels(d.fx_pixels)), "mean")


@query("""WITH s AS (SELECT core, slice_z, label, count(*) AS area FROM fx_mask GROUP BY 1, 2, 3), n AS (SELECT core, slice_z, max(label) AS n FROM s GROUP BY 1, 2),
g AS (SELECT core, slice_z, n, unnest(range(1, n + 1)) AS label FROM n), f AS (SELECT g.core AS core, g.slice_z AS slice_z, n, coalesce(area, 0) AS area FROM g LEFT JOIN s USING (core, slice_z, label)),
a AS (SELECT core, slice_z, first(n) AS n, avg(area) AS mean, median(area) AS med, sum(area) AS total FROM f GROUP BY 1, 2)
SELECT p.core AS core, p.slice_z AS slice_z, coalesce(n, 0)::BIGINT AS n_cells, round(coalesce(mean, 0), 6) AS mean_area_px, coalesce(med, 0)::DOUBLE AS median_area_px, coalesce(total, 0)::BIGINT AS total_area_px,
  CASE WHEN n > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM (SELECT DISTINCT core, slice_z FROM fx_pixels UNION SELECT DISTINCT core, 99 FROM fx_pixels) p LEFT JOIN a USING (core, slice_z)""")
def a3_segmentation_stats(d):
    """Section 99 of each core is a plane without labels."""
    planes = d.fx_pixels.select("core", "slice_z").union(d.fx_pixels.select("core", F.lit(99).cast(d.fx_pixels.schema["slice_z"].dataType)))
    out = A.segmentation_stats(planes, A.label_stats(d.fx_mask))
    return rounded(out, "mean_area_px").drop("total_area_um2")


@query("""WITH s AS (SELECT core, slice_z, avg(v) AS t FROM fx_pixels GROUP BY 1, 2), a AS (SELECT core, slice_z, sum((v > t)::INTEGER) AS area FROM fx_pixels JOIN s USING (core, slice_z) GROUP BY 1, 2)
SELECT core, round(avg(area), 6) AS mean_area, count(*) AS n_slices FROM a GROUP BY 1""")
def a16_tissue_area(d):
    means = d.fx_pixels.groupBy(*PLANE).agg(F.avg("v").alias("threshold"))
    return rounded(A.tissue_area(d.fx_pixels, means), "mean_area")


@query("""WITH o AS (SELECT core % 3 AS quality, core, avg(area) AS mean_area FROM fx_areas GROUP BY 1, 2)
SELECT quality, count(*) AS n_cores, round(avg(mean_area), 6) AS mean, round(median(mean_area), 6) AS median, round(min(mean_area), 6) AS min, round(max(mean_area), 6) AS max FROM o GROUP BY 1""")
def a16_area_by_quality(d):
    means = d.fx_areas.groupBy("core").agg(F.avg("area").alias("mean_area")).withColumn("quality", F.col("core") % 3)
    return rounded(A.area_by_quality(means), "mean", "median", "min", "max")


@query("""WITH s AS (SELECT core, slice_z, label, avg(y) AS cy, avg(x) AS cx FROM fx_mask GROUP BY 1, 2, 3),
t AS (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS step FROM s WINDOW w AS (PARTITION BY core, label ORDER BY slice_z))
SELECT core, label, round(max(cx) - min(cx), 6) AS range_x, round(max(cy) - min(cy), 6) AS range_y, round(coalesce(sum(step), 0), 6) AS path, count(*) AS n_slices FROM t GROUP BY 1, 2""")
def a23_centroid_drift_path(d):
    return rounded(A.centroid_drift_path(A.label_stats(d.fx_mask)), "range_x", "range_y", "path")


RINGS = "rings AS (SELECT core, slice_z, floor(sqrt((y - 3) ** 2 + (x - 3) ** 2))::BIGINT AS r, v FROM fx_pixels), prof AS (SELECT core, slice_z, r, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, count(*) AS n FROM rings GROUP BY 1, 2, 3)"


@query(f"WITH {RINGS} SELECT core, slice_z, r, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, n FROM prof")
def a28_radial_profile(d):
    return rounded(A.radial_profile(d.fx_pixels, 3, 3), "mean", "std", "median")


@query(f"""WITH {RINGS}, low AS (SELECT core, slice_z, arg_min(r, (mean, r)) AS dip_r, min(mean) AS dip FROM prof WHERE r >= 2 GROUP BY 1, 2),
aft AS (SELECT core, slice_z, dip_r, dip, arg_max(r, (mean, -r)) AS halo_r, max(mean) AS halo FROM prof JOIN low USING (core, slice_z) WHERE r >= dip_r GROUP BY 1, 2, 3, 4)
SELECT core, slice_z, dip_r, round(dip, 6) AS dip, halo_r, round(halo, 6) AS halo FROM aft""")
def a28_halo_summary(d):
    out = A.halo_summary(A.radial_profile(d.fx_pixels, 3, 3), search_um=1.0)
    return rounded(out, "dip", "halo").select(*PLANE, "dip_r", "dip", "halo_r", "halo")


@query("""WITH j AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM fx_pixels),
b AS (SELECT core % 2 AS side, least(floor((v - lo) / (hi - lo) * 79), 78) AS bin, count(*) AS n FROM fx_pixels, j WHERE v BETWEEN lo AND hi GROUP BY 1, 2),
p AS (SELECT side, bin, n / sum(n) OVER (PARTITION BY side) AS p FROM b)
SELECT round(sum(least(coalesce(x.p, 0), coalesce(y.p, 0))), 6) AS overlap FROM (SELECT * FROM p WHERE side = 0) x FULL JOIN (SELECT * FROM p WHERE side = 1) y ON x.bin = y.bin""")
def a29_hist_separability(d):
    part = lambda side: d.fx_pixels.filter(F.col("core") % 2 == side)
    return rounded(A.hist_separability(part(0), part(1), "v"), "overlap")


@query("""WITH t AS (SELECT unnest([0, 1]) AS tile), v AS (SELECT core, slice_z, y, x, tile, CASE WHEN tile = 1 AND slice_z % 5 = 0 THEN 0 ELSE v + tile END AS v,
  exp(-0.5::DOUBLE * (((y - 4.0::DOUBLE) / (8 / 2.5::DOUBLE)) ** 2 + ((x - (tile * 2 + 3.0::DOUBLE)) / (6 / 2.5::DOUBLE)) ** 2)) AS w FROM fx_pixels, t WHERE x >= tile * 2 AND x < tile * 2 + 6)
SELECT core, slice_z, y, x, round(sum(w * v) / greatest(sum(w), 1e-6), 6) AS v FROM v GROUP BY 1, 2, 3, 4""")
def a32_merge_tiles(d):
    start = F.col("tile") * 2
    values = d.fx_pixels.withColumn("tile", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("x") >= start) & (F.col("x") < start + 6))
    values = values.withColumn("v", F.when(~((F.col("tile") == 1) & (F.col("slice_z") % 5 == 0)), F.col("v") + F.col("tile"))).drop("vec_id")
    tiles = d.fx_pixels.select(*PLANE).distinct().withColumn("tile", F.explode(F.array(F.lit(0), F.lit(1))))
    tiles = tiles.withColumns({"y0": F.lit(0), "y1": F.lit(8), "x0": F.col("tile") * 2, "x1": F.col("tile") * 2 + 6})
    return rounded(A.merge_tiles(values, tiles, PLANE), "v")


@query("SELECT m.core AS core, m.slice_z AS slice_z, p.y AS y, p.x AS x, round(coalesce(s.area, 0) * 1.5::DOUBLE, 6) AS painted FROM fx_pixels p JOIN (SELECT DISTINCT core, slice_z FROM fx_mask) m USING (core, slice_z) LEFT JOIN fx_mask k ON k.core = p.core AND k.slice_z = p.slice_z AND k.y = p.y AND k.x = p.x LEFT JOIN (SELECT core, slice_z, label, count(*) AS area FROM fx_mask WHERE label % 3 <> 0 GROUP BY 1, 2, 3) s ON s.core = p.core AND s.slice_z = p.slice_z AND s.label = k.label")
def j10_paint_labels(d):
    values = A.label_stats(d.fx_mask).filter("label % 3 <> 0").withColumn("painted", F.col("area_px") * 1.5)
    labelled = d.fx_pixels.drop("vec_id", "v").join(d.fx_mask, [*PLANE, "y", "x"], "left")
    return J.paint_labels(labelled, values, PLANE, "painted").select(*PLANE, "y", "x", "painted")


@query("""WITH c AS (SELECT core, slice_z, y, x, y + i AS ky, x + j AS kx, CASE i WHEN 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * 0.5::DOUBLE AS w FROM fx_pixels, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT c.core AS core, c.slice_z AS slice_z, c.y AS y, c.x AS x, round(sum(w * coalesce(p.v, 0)), 6) AS v FROM c LEFT JOIN fx_pixels p ON p.core = c.core AND p.slice_z = c.slice_z AND c.ky < 8 AND c.kx < 8 AND p.y = c.ky - 1 AND p.x = c.kx + 1 GROUP BY 1, 2, 3, 4""")
def j11_warp_values(d):
    """Planes through a field half a pixel to the right and a quarter down, and an affine shift."""
    from lamella.operators import project as P

    m = P.affine(*[F.lit(v) for v in (1.0, 0.0, -1.0, 0.0, 1.0, 1.0)])
    header = d.fx_pixels.select(*PLANE).distinct().select(*PLANE, m.alias("m"), F.lit(8).alias("orig_h"), F.lit(8).alias("orig_w"))
    field = d.fx_pixels.select(*PLANE, "y", "x", (F.col("x") + 0.5).alias("map_x"), (F.col("y") + 0.25).alias("map_y"))
    return rounded(J.warp_values(d.fx_pixels, header, field, PLANE), "v")


@query("""SELECT k.core AS core, k.slice_z AS slice_z, p.y AS y, p.x AS x, k.label AS label FROM fx_pixels p JOIN fx_mask k ON k.core = p.core AND k.slice_z = p.slice_z AND k.y = p.x - 1 AND k.x = p.y + 1 WHERE p.slice_z % 2 = 0 AND p.x - 1 >= 0 AND p.y + 1 < 8 AND p.y < 8 AND p.x < 8
UNION ALL SELECT core, slice_z, y, x, label FROM fx_mask WHERE slice_z % 2 = 1""")
def j11_remap_labels(d):
    """Even slices through a field that transposes and an affine shift; odd ones have no header and stay."""
    return J.remap_labels(d.fx_mask, *transposing(d), PLANE)


@query(like="j11_remap_labels")
def j11_remap_runs(d):
    """The same from runs to runs, shown as pixels."""
    return R.pixels_of_runs(R.remap_runs(R.runs_of_pixels(d.fx_mask), *transposing(d), PLANE))


def transposing(d):
    from lamella.operators import project as P

    planes = d.fx_pixels.filter("slice_z % 2 = 0")
    m = P.affine(*[F.lit(v) for v in (1.0, 0.0, -1.0, 0.0, 1.0, 1.0)])
    header = planes.select(*PLANE).distinct().select(*PLANE, m.alias("m"), F.lit(8).alias("orig_h"), F.lit(8).alias("orig_w"))
    field = planes.select(*PLANE, "y", "x", F.col("y").cast("double").alias("map_x"), F.col("x").cast("double").alias("map_y"))
    return header, field


@query("SELECT core, z, count(*) AS n_px, round(avg((a - b) ** 2), 9) AS mse, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(20 * log10(greatest(max(a), max(b), 1) / sqrt(avg((a - b) ** 2))), 6) AS psnr, round(corr(a, b), 6) AS ncc FROM fx_pairs GROUP BY 1, 2")
def m1_error_metrics(d):
    """mse, rmse (M1), psnr (M2) and ncc (M3)."""
    return rounded(rounded(M.error_metrics(pairs(d)), "rmse", "psnr", "ncc"), "mse", digits=9)


INFO = """tot AS (SELECT core, z, i, j, n / sum(n) OVER (PARTITION BY core, z) AS p FROM joint), mar AS (SELECT *, sum(p) OVER (PARTITION BY core, z, i) AS pi, sum(p) OVER (PARTITION BY core, z, j) AS pj FROM tot),
info AS (SELECT core, z, sum(p * ln(p / (pi * pj))) AS mi, -sum(p * ln(pi)) AS ha, -sum(p * ln(pj)) AS hb, -sum(p * ln(p)) AS hab FROM mar GROUP BY 1, 2)"""


@query(f"""WITH e AS (SELECT core, z, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM fx_pairs GROUP BY 1, 2),
joint AS (SELECT core, z, least(floor((a - a0) / (a1 - a0) * 64), 63) AS i, least(floor((b - b0) / (b1 - b0) * 64), 63) AS j, count(*) AS n FROM fx_pairs JOIN e USING (core, z) GROUP BY 1, 2, 3, 4), {INFO}
SELECT core, z, round(mi, 6) AS mi, round((ha + hb) / hab, 6) AS nmi FROM info""")
def m4_mutual_information(d):
    """mi (M4) and the entropy form of nmi (M5)."""
    return rounded(M.mutual_information(pairs(d)), "mi", "nmi")


@query(f"""WITH joint AS (SELECT core, z, floor(a * 10) AS i, floor(b * 10) AS j, count(*) AS n FROM fx_pairs GROUP BY 1, 2, 3, 4), {INFO}
SELECT core, z, round(2 * mi / (ha + hb), 6) AS nmi_label FROM info""")
def m6_nmi_label(d):
    levels = pairs(d).withColumns({"a": F.floor(F.col("a") * 10).cast("double"), "b": F.floor(F.col("b") * 10).cast("double")})
    return rounded(M.nmi_label(levels), "nmi_label")


@query("""WITH s AS (SELECT core, z, y, x, a / greatest(max(a) OVER p, max(b) OVER p, 1) AS a, b / greatest(max(a) OVER p, max(b) OVER p, 1) AS b FROM fx_pairs WINDOW p AS (PARTITION BY core, z)),
w AS (SELECT c.core AS core, c.z AS z, c.y AS y, c.x AS x, avg(s.a) AS ma, avg(s.b) AS mb, var_samp(s.a) AS va, var_samp(s.b) AS vb, covar_samp(s.a, s.b) AS cov FROM s c JOIN s ON s.core = c.core AND s.z = c.z AND abs(s.y - c.y) <= 3 AND abs(s.x - c.x) <= 3
  WHERE c.y BETWEEN 3 AND 4 AND c.x BETWEEN 3 AND 4 GROUP BY 1, 2, 3, 4)
SELECT core, z, round(avg((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))), 6) AS ssim FROM w GROUP BY 1, 2""")
def m7_ssim(d):
    return rounded(M.ssim(pairs(d)), "ssim")




@query("""WITH k AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) t(dy, dx, wx, wy)),
g AS (SELECT p.core AS core, p.z AS z, p.y AS y, p.x AS x, sqrt(sum(wx * q.a) ** 2 + sum(wy * q.a) ** 2) AS ga, sqrt(sum(wx * q.b) ** 2 + sum(wy * q.b) ** 2) AS gb FROM fx_pairs p CROSS JOIN k
  JOIN fx_pairs q ON q.core = p.core AND q.z = p.z AND q.y = greatest(least(p.y + dy, 7), 0) AND q.x = greatest(least(p.x + dx, 7), 0) GROUP BY 1, 2, 3, 4)
SELECT core, z, round(corr(ga, gb), 6) AS grad_corr FROM g GROUP BY 1, 2""")
def m8_grad_corr(d):
    return rounded(M.grad_corr(pairs(d)), "grad_corr")


def _otsu(side: str) -> str:
    return f"""e{side} AS (SELECT core, z, min({side}) AS lo, max({side}) AS hi FROM fx_pairs GROUP BY 1, 2),
h{side} AS (SELECT core, z, least(floor(({side} - lo) / (hi - lo) * 256), 255)::INTEGER AS bin, count(*) AS n, first(lo) AS lo, first(hi) AS hi FROM fx_pairs JOIN e{side} USING (core, z) GROUP BY 1, 2, 3),
c{side} AS (SELECT *, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS c FROM h{side}),
r{side} AS (SELECT *, sum(n) OVER g AS t, sum(n * c) OVER g AS m, sum(n) OVER u AS w0, sum(n * c) OVER u AS m0 FROM c{side} WINDOW g AS (PARTITION BY core, z), u AS (PARTITION BY core, z ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v{side} AS (SELECT *, round(CASE WHEN t > w0 THEN w0::DOUBLE * (t - w0) * (m0 / w0 - (m - m0) / (t - w0)) ** 2 ELSE 0 END / (t::DOUBLE * t), 12) AS v FROM r{side}),
t{side} AS (SELECT core, z, arg_max(c, (v, -bin)) AS t{side} FROM v{side} GROUP BY 1, 2)"""


@query(f"WITH {_otsu('a')}, {_otsu('b')} SELECT core, z, round(sum((a > ta AND b > tb)::INTEGER)::DOUBLE / sum((a > ta OR b > tb)::INTEGER), 6) AS jaccard FROM fx_pairs JOIN ta USING (core, z) JOIN tb USING (core, z) GROUP BY 1, 2")
def m9_jaccard(d):
    return rounded(M.jaccard(pairs(d)), "jaccard")


@query(f"WITH {_otsu('a')} SELECT core, z, round(sqrt(avg((a - b) ** 2)), 6) AS rmse_masked, round(corr(a, b), 6) AS ncc_masked FROM fx_pairs JOIN ta USING (core, z) WHERE a > ta GROUP BY 1, 2 HAVING count(*) >= 2")
def m10_masked_rmse_ncc(d):
    return rounded(M.masked_rmse_ncc(pairs(d)), "rmse_masked", "ncc_masked")


@query("""WITH m AS (SELECT core, slice_z, max(v) AS top FROM fx_pixels GROUP BY 1, 2), q AS (SELECT p.core AS core, p.slice_z AS slice_z, y, x, floor(greatest(v / top, 0) * 15) AS q FROM fx_pixels p JOIN m ON m.core = p.core AND m.slice_z = p.slice_z),
s AS (SELECT *, lead(q) OVER (PARTITION BY core, slice_z, y ORDER BY x) - q AS s FROM q) SELECT core, slice_z, round(avg(s * s), 6) AS contrast FROM s GROUP BY 1, 2""")
def m11_glcm_contrast(d):
    return rounded(M.glcm_contrast(d.fx_pixels, PLANE), "contrast")


@query("""WITH t AS (SELECT core, z, floor(y / 2) * 4 + floor(x / 2) AS tile, CASE WHEN stddev_pop(a) >= 1e-3 AND stddev_pop(b) >= 1e-3 THEN round(corr(a, b), 4) END AS ncc FROM fx_pairs GROUP BY 1, 2, 3)
SELECT core, z, count(ncc) AS n_tiles, min(ncc) AS ncc_min, max(ncc) AS ncc_max FROM t GROUP BY 1, 2""")
def m12_tile_ncc(d):
    out = M.tile_ncc(pairs(d), 8, 8)
    n = F.size(F.filter("ncc_tiles", lambda v: v.isNotNull())).cast("long")
    return out.select("core", "z", n.alias("n_tiles"), "ncc_min", F.array_max("ncc_tiles").alias("ncc_max"))


@query("SELECT core, slice_z, floor(y / 3)::BIGINT AS y, floor(x / 3)::BIGINT AS x, round(sum(v) / 9, 6) AS v FROM fx_pixels GROUP BY 1, 2, 3, 4")
def m13_mean_pool(d):
    return rounded(M.mean_pool(d.fx_pixels, PLANE, n=3), "v")


@query("SELECT p.core AS core, z, round(-corr(a, b), 6) AS signed_ncc FROM fx_pairs p JOIN fx_mask m ON m.core = p.core AND m.slice_z = p.z AND m.y = p.y AND m.x = p.x GROUP BY 1, 2")
def m14_signed_ncc_masked(d):
    mask = d.fx_mask.withColumnRenamed("slice_z", "z")
    return rounded(M.signed_ncc_masked(pairs(d), mask), "signed_ncc")


@query("""WITH p AS (SELECT core, z, floor(y / 4) AS y, floor(x / 4) AS x, sum(a) / 16 AS a, sum(b) / 16 AS b FROM fx_pairs GROUP BY 1, 2, 3, 4)
SELECT core, z, round(avg((a - b) ** 2), 9) AS mse, round(corr(a, b), 6) AS ncc, 'pooled' AS stage FROM p GROUP BY 1, 2
UNION ALL SELECT core, z, round(avg((a - b) ** 2), 9), round(corr(a, b), 6), 'full' FROM fx_pairs GROUP BY 1, 2""")
def m15_score_pairs(d):
    full = M.score_pairs(pairs(d)).withColumn("stage", F.lit("full"))
    both = full.unionByName(M.score_pairs(pairs(d), pool=4).withColumn("stage", F.lit("pooled")))
    return rounded(rounded(both, "ncc"), "mse", digits=9).select("core", "z", "mse", "ncc", "stage")


@query("SELECT core, slice_z, floor(v * 1000)::BIGINT AS level, count(*) AS n FROM fx_pixels GROUP BY 1, 2, 3")
def s9_pixels(d):
    """Planes stored as one array per vector, as pixel rows."""
    from lamella.sources.pixels import pixels

    planes = d.embeddings.select(F.floor(F.col("vec_id") / 20).alias("core"), (F.col("vec_id") % 20).alias("slice_z"), F.col("embedding").cast("array<double>").alias("values"))
    rows = pixels(planes, width=8, keys=PLANE)
    return rows.groupBy(*PLANE, F.floor(F.col("v") * 1000).alias("level")).agg(F.count("*").alias("n"))


def tissue_threshold(d):
    return T.otsu(d.fx_pixels, "v", PLANE)
