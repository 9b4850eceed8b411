"""Queries over keypoints, patches and region candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import joins as J
from lamella.operators import keypoints as K
from lamella.plans.base import query

POINTS = "pts AS (SELECT slide AS image_id, cand_id AS kp_id, cx::DOUBLE AS x, cy::DOUBLE AS y, ((cand_id * 7919) % 10007)::DOUBLE AS response FROM fx_candidates)"


def points(d):
    response = ((F.col("cand_id") * 7919) % 10007).cast("double")
    return d.fx_candidates.select(F.col("slide").alias("image_id"), F.col("cand_id").alias("kp_id"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), response.alias("response"))


@query(f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY response DESC, kp_id) AS r FROM pts) SELECT image_id, kp_id, response FROM r WHERE r <= 25")
def k1_cap_by_response(d):
    return K.cap_by_response(points(d), 25).select("image_id", "kp_id", "response")


def _anms(c: str, response: str, n: int) -> str:
    return f"""rad AS (SELECT a.image_id AS image_id, a.kp_id AS kp_id, a.{response} AS response, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS r2 FROM pts a LEFT JOIN pts b ON a.image_id = b.image_id AND b.{response} * {c} > a.{response} GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r2 DESC NULLS FIRST, response DESC, kp_id) AS r, count(*) OVER (PARTITION BY image_id) AS k FROM rad) SELECT image_id, kp_id, CASE WHEN k <= {n} THEN NULL ELSE r2 END AS radius_sq FROM rk WHERE r <= {n}"""


@query(f"WITH {POINTS}, {_anms('0.9::DOUBLE', 'response', 40)}")
def k2_anms(d):
    return K.anms(points(d), 40).select("image_id", "kp_id", "radius_sq")


@query(f"WITH {POINTS.replace('AS response FROM', 'AS response, sqrt(w * w + h * h) AS size FROM')}, {_anms('1.0::DOUBLE', 'size', 40)}")
def k3_thin_landmarks(d):
    moved = points(d).join(d.fx_candidates.select(F.col("cand_id").alias("kp_id"), F.col("w").alias("dx"), F.col("h").alias("dy")), "kp_id")
    return K.thin_landmarks(moved, 40).select("image_id", "kp_id", "radius_sq")


MATCH = """two AS (SELECT a.image_id AS image_id, a.kp_id AS kp_id, b.kp_id AS match_id, bit_count(xor(a.d, b.d))::INTEGER AS dist FROM fx_desc a JOIN fx_desc b ON a.image_id = b.image_id AND a.kp_id % 2 = 0 AND b.kp_id % 2 = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, kp_id ORDER BY dist, match_id) AS r FROM two),
best AS (SELECT image_id, kp_id, max(CASE WHEN r = 1 THEN match_id END) AS match_id, max(CASE WHEN r = 1 THEN dist END) AS d1, max(CASE WHEN r = 2 THEN dist END) AS d2 FROM rk WHERE r <= 2 GROUP BY 1, 2),
matched AS (SELECT *, coalesce(d1 < 0.8::DOUBLE * d2, false) AS good FROM best)"""


def matches(d):
    return J.match_descriptors(d.fx_desc.filter("kp_id % 2 = 0"), d.fx_desc.filter("kp_id % 2 = 1"), 0.8, ["image_id"])


@query(f"WITH {MATCH} SELECT image_id, kp_id, match_id, d1, d2, good FROM matched")
def j15_match_descriptors(d):
    return matches(d)


@query(f"""WITH {MATCH}, q AS (SELECT image_id, count(*) AS n_points, sum(good::INTEGER)::BIGINT AS n_matches, sum((good AND kp_id % 3 = 0)::INTEGER)::BIGINT AS n_inliers FROM matched GROUP BY 1)
SELECT *, CASE WHEN n_matches > 0 THEN n_inliers::DOUBLE / n_matches END AS inlier_ratio, n_matches < 4 AS starved FROM q""")
def k4_match_quality(d):
    return K.match_quality(matches(d).withColumn("inlier", F.col("kp_id") % 3 == 0))


PICKS = ", ".join(
    f"""b{i} AS (SELECT image_id, kp_id, x, y, response, {i} AS pick FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY response DESC, kp_id) AS r FROM r{i - 1}) WHERE r = 1),
r{i} AS (SELECT r.* FROM r{i - 1} r JOIN b{i} b ON b.image_id = r.image_id WHERE sqrt((r.x - b.x) ** 2 + (r.y - b.y) ** 2) >= 150)"""
    for i in range(1, 7)
)


@query(f"WITH {POINTS}, r0 AS (SELECT * FROM pts), {PICKS} " + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, 7)))
def k5_greedy_spatial_topk(d):
    return K.greedy_spatial_topk(points(d), 6, 150.0, "response")


@query("""WITH l AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS v FROM (SELECT label, vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), m AS (SELECT label, i, avg(v) AS m FROM l GROUP BY 1, 2),
o AS (SELECT label, vec_id, sqrt(sum((v - m) ** 2)) AS distance FROM l JOIN m USING (label, i) GROUP BY 1, 2)
SELECT label, vec_id, round(distance, 5) AS distance, round((distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) * 100, 4) AS uniqueness FROM o WINDOW w AS (PARTITION BY label)""")
def k6_uniqueness(d):
    out = K.uniqueness(d.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"], "vec_id")
    return out.select("label", "vec_id", F.round("distance", 5).alias("distance"), F.round("uniqueness", 4).alias("uniqueness"))


PATCHES = "pat AS (SELECT core, slice_z, y, x, v, unnest(range(0, 3)) AS py FROM fx_pixels), pt AS (SELECT *, unnest(range(0, 3)) AS px FROM pat WHERE y >= py * 2 AND y < py * 2 + 4), patches AS (SELECT core, slice_z, py, px, y, x, v FROM pt WHERE x >= px * 2 AND x < px * 2 + 4)"


@query(f"WITH {PATCHES} SELECT core, slice_z, py, px, avg((v > 0)::INTEGER)::DOUBLE AS tissue_share, round(stddev_pop(v), 6) AS std FROM patches GROUP BY 1, 2, 3, 4 HAVING avg((v > 0)::INTEGER) >= 0.5 AND stddev_pop(v) >= 0.05")
def k7_patch_grid_filter(d):
    out = K.patch_grid_filter(d.fx_pixels, 4, 2, 8, 8, least_std=0.05)
    return out.withColumn("std", F.round("std", 6))


@query(f"""WITH {PATCHES}, s AS (SELECT core, slice_z, py, px, max(v) AS score FROM patches GROUP BY 1, 2, 3, 4)
SELECT core, slice_z, y, x, round(avg(score), 6) AS heat, count(*) AS n_patches FROM patches JOIN s USING (core, slice_z, py, px) GROUP BY 1, 2, 3, 4""")
def k8_patch_heatmap(d):
    scores = K.to_patches(d.fx_pixels, 4, 2, 8, 8).groupBy("core", "slice_z", "py", "px").agg(F.max("v").alias("score"))
    return K.patch_heatmap(d.fx_pixels, scores, 4, 2, 8, 8).withColumn("heat", F.round("heat", 6))


@query("""WITH p AS (SELECT core, cluster_id AS landmark_idx, slice_id, min(cx) AS x, min(cy) AS y FROM fx_cells GROUP BY 1, 2, 3)
SELECT core, landmark_idx, slice_id, x - lag(x) OVER w AS step_x, y - lag(y) OVER w AS step_y, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 6) AS step FROM p WINDOW w AS (PARTITION BY core, landmark_idx ORDER BY slice_id)""")
def k9_trajectory_steps(d):
    marks = d.fx_cells.groupBy("core", F.col("cluster_id").alias("landmark_idx"), "slice_id").agg(F.min("cx").alias("x"), F.min("cy").alias("y"))
    return K.trajectory_steps(marks).select("core", "landmark_idx", "slice_id", "step_x", "step_y", F.round("step", 6).alias("step"))


@query("WITH r AS (SELECT slide, cand_id, row_number() OVER (PARTITION BY slide ORDER BY area * w DESC, cand_id) AS rank FROM fx_candidates) SELECT slide, cand_id, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def k10_top_artifacts(d):
    blobs = d.fx_candidates.select("slide", "cand_id", F.col("area").alias("area_px"), F.col("w").alias("peak"))
    return K.top_artifacts(blobs, 3, ["slide"], "cand_id").select("slide", "cand_id", "rank")


@query("""WITH p AS (SELECT slide, cand_id AS point_id, cx, cy FROM fx_candidates WHERE w = 40), r AS (SELECT p.slide AS slide, point_id, c.cand_id AS region_id, c.area > 3000 AS passed, abs(c.cy - p.cy) + abs(c.cx - p.cx) AS l1,
  row_number() OVER (PARTITION BY p.slide, point_id ORDER BY abs(c.cy - p.cy) + abs(c.cx - p.cx), c.cand_id) AS r FROM p JOIN fx_candidates c ON c.slide = p.slide AND c.w > 42)
SELECT slide, point_id, region_id, passed, l1 FROM r WHERE r = 1""")
def k11_nearest_region(d):
    picked = d.fx_candidates.filter("w = 40").select("slide", F.col("cand_id").alias("point_id"), F.col("cy").alias("y"), F.col("cx").alias("x"))
    regions = d.fx_candidates.filter("w > 42").select("slide", F.col("cand_id").alias("region_id"), F.col("cy").alias("row"), F.col("cx").alias("col"), (F.col("area") > 3000).alias("passed"))
    return K.nearest_region(picked, regions, ["slide"], passed="passed")
