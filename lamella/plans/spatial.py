"""Queries over cell positions: neighbours, densities and interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import aggregate as A
from lamella.operators import spatial as S
from lamella.plans.base import query

SLICE = ["core", "slice_id"]
NEAREST = """nn AS (SELECT a.core AS core, a.slice_id AS slice_id, a.cell_type AS src_type, b.cell_type AS tgt_type, a.cell_id AS cell_id, min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS dist
  FROM fx_cells a JOIN fx_cells b ON a.core = b.core AND a.slice_id = b.slice_id AND a.cell_id <> b.cell_id GROUP BY 1, 2, 3, 4, 5)"""


def distances(d):
    return S.type_distances(d.fx_cells, ["cx", "cy"], SLICE)


@query(f"WITH {NEAREST} SELECT core, slice_id, src_type, tgt_type, cell_id, round(dist, 6) AS dist FROM nn")
def j7_nearest_neighbour(d):
    return distances(d).withColumn("dist", F.round("dist", 6)).select("core", "slice_id", "src_type", "tgt_type", "cell_id", "dist")


@query(f"""WITH {NEAREST}, per AS (SELECT core, src_type, tgt_type, slice_id, avg(dist) AS m, stddev_pop(dist) AS s, count(*) AS n FROM nn GROUP BY 1, 2, 3, 4)
SELECT core, src_type, tgt_type, round(avg(m), 6) AS mean_dist_um, round(stddev_samp(m), 6) AS std_across_slices, round(avg(s), 6) AS mean_within_std, count(DISTINCT slice_id) AS n_slices, sum(n)::BIGINT AS n_src_cells FROM per GROUP BY 1, 2, 3""")
def a10_nn_summary(d):
    out = A.nn_summary(distances(d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_dist_um", "std_across_slices", "mean_within_std")})


@query("""SELECT a.core AS core, a.cell_id AS cell_id, round(min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.slice_id * 9.0::DOUBLE - b.slice_id * 9.0::DOUBLE) ** 2)), 6) AS dist,
  min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.slice_id * 9.0::DOUBLE - b.slice_id * 9.0::DOUBLE) ** 2)) <= 20 AS colocalised
FROM fx_cells a JOIN fx_cells b ON a.core = b.core AND a.pos_CK = 1 AND b.pos_CD3 = 1 GROUP BY 1, 2""")
def j8_colocalise(d):
    cells = d.fx_cells.withColumn("cz", F.col("slice_id") * 9.0)
    a, b = cells.filter("pos_CK = 1"), cells.filter("pos_CD3 = 1")
    return S.colocalise(a, b, ["cx", "cy", "cz"], 20.0).withColumn("dist", F.round("dist", 6))


GRAPH = "graph AS (SELECT a.core AS core, a.slice_id AS slice_id, a.cell_id AS src, b.cell_id AS dst, a.cell_type AS ta, b.cell_type AS tb, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist FROM fx_cells a JOIN fx_cells b ON a.core = b.core AND a.slice_id = b.slice_id AND a.cell_id <> b.cell_id WHERE (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 2500)"


@query(f"WITH {GRAPH} SELECT core, slice_id, src, dst, round(dist, 6) AS dist FROM graph")
def j9_radius_graph(d):
    return S.radius_graph(d.fx_cells, 50, ["cx", "cy"], SLICE, digits=6)


@query(f"""WITH {GRAPH}, n AS (SELECT core, slice_id, cell_type, count(*) AS n FROM fx_cells GROUP BY 1, 2, 3), g AS (SELECT core, slice_id, ta, tb, count(*) AS k FROM graph GROUP BY 1, 2, 3, 4)
SELECT a.core AS core, a.slice_id AS slice_id, a.cell_type AS src_type, b.cell_type AS tgt_type, a.n AS n_src, coalesce(k, 0) AS n_pairs, round(coalesce(k, 0)::DOUBLE / a.n, 6) AS observed
FROM n a JOIN n b ON a.core = b.core AND a.slice_id = b.slice_id LEFT JOIN g ON g.core = a.core AND g.slice_id = a.slice_id AND ta = a.cell_type AND tb = b.cell_type""")
def x1_observed_interactions(d):
    return S.observed_within(d.fx_cells, 50, ["cx", "cy"], SLICE).withColumn("observed", F.round("observed", 6))


@query()
def x3_interaction_scores(d):
    """Scores per core from 1000 permutations (X2, X3); compared with the exact mean and deviation in the tests."""
    return S.interactions(d.fx_cells, ["cx", "cy"])


@query()
def x4_interactions_2d(d):
    return S.interactions_2d(d.fx_cells, ["cx", "cy"])


@query()
def x5_interactions_3d(d):
    return S.interactions(d.fx_cells.withColumn("cz", F.col("slice_id") * 4.5), ["cx", "cy", "cz"])


@query()
def x6_proximity_to(d):
    return S.proximity_to(S.interactions(d.fx_cells, ["cx", "cy"]), "error")


def _exact(keys: str, far: str) -> str:
    """Mean and deviation over all permutations of types on a symmetric graph within 50 um, from the sums of degrees."""
    alike, pair, three, four = "ta = tb", "{} / (n * (n - 1))", "{} / (n * (n - 1) * (n - 2))", "{} / (n * (n - 1) * (n - 2) * (n - 3))"
    case = lambda a, b: f"CASE WHEN {alike} THEN {a} ELSE {b} END"
    return f"""enough AS (SELECT {keys}, cell_type FROM fx_cells GROUP BY ALL HAVING count(*) >= 10), several AS (SELECT {keys} FROM enough GROUP BY ALL HAVING count(*) >= 2),
us AS (SELECT {keys}, cell_id, cell_type, cx, cy, slice_id * 4.5::DOUBLE AS cz FROM fx_cells JOIN enough USING ({keys}, cell_type) JOIN several USING ({keys})),
near AS (SELECT {", ".join(f"a.{k.strip()} AS {k.strip()}" for k in keys.split(","))}, a.cell_id AS src, a.cell_type AS ta, b.cell_type AS tb FROM us a JOIN us b ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} AND a.cell_id <> b.cell_id WHERE (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2{far} <= 2500),
deg AS (SELECT {keys}, src, count(*)::DOUBLE AS d FROM near GROUP BY ALL), tot AS (SELECT {keys}, sum(d) AS m, sum(d * (d - 1)) AS fan FROM deg GROUP BY ALL),
kinds AS (SELECT {keys}, cell_type, count(*)::DOUBLE AS k FROM us GROUP BY ALL), size AS (SELECT {keys}, count(*)::DOUBLE AS n FROM us GROUP BY ALL), hits AS (SELECT {keys}, ta, tb, count(*) AS c FROM near GROUP BY ALL),
grid AS (SELECT {", ".join(f"a.{k.strip()} AS {k.strip()}" for k in keys.split(","))}, a.cell_type AS ta, b.cell_type AS tb, a.k AS s, b.k AS t FROM kinds a JOIN kinds b ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))}),
raw AS (SELECT {keys}, ta, tb, s, coalesce(c, 0) / s AS observed, coalesce(m, 0) AS m,
  {case(pair.format("s * (s - 1)"), pair.format("s * t"))} AS p2,
  coalesce({case(f"2 * m * {pair.format('s * (s - 1)')}", f"m * {pair.format('s * t')}")}
    + {case(f"4 * fan * {three.format('s * (s - 1) * (s - 2)')}", f"fan * ({three.format('s * t * (t - 1)')} + {three.format('s * (s - 1) * t')})")}
    + (m * m - 2 * m - 4 * fan) * {case(four.format("s * (s - 1) * (s - 2) * (s - 3)"), four.format("s * (s - 1) * t * (t - 1)"))}, 0) AS second
  FROM grid JOIN size USING ({keys}) LEFT JOIN tot USING ({keys}) LEFT JOIN hits USING ({keys}, ta, tb)),
moments AS (SELECT {keys}, ta AS src_type, tb AS tgt_type, observed, m * p2 / s AS null_mean, sqrt(greatest(second - (m * p2) ** 2, 0)) / s AS sd FROM raw),
scores AS (SELECT {keys}, src_type, tgt_type, observed, null_mean, sd AS null_std, CASE WHEN sd > 1e-6 THEN (observed - null_mean) / sd ELSE 0 END AS z FROM moments)"""


ROUNDED = "round(observed, 6) AS observed, round(null_mean, 5) AS null_mean, round(null_std, 4) AS null_std, round(z, 4) AS z_score"


def rounded(out):
    return out.withColumns({c: F.round(c, n) for c, n in (("observed", 6), ("null_mean", 5), ("null_std", 4), ("z_score", 4))})


@query(f"WITH {_exact('core', '')} SELECT core, src_type, tgt_type, {ROUNDED} FROM scores")
def x2_exact_null(d):
    """Scores per core from the exact mean and deviation of the permutations."""
    return rounded(S.exact_interactions(d.fx_cells, ["cx", "cy"]))


@query(f"WITH {_exact('core, slice_id', '')} SELECT core, src_type, tgt_type, round(avg(z), 4) AS mean_z, round(stddev_samp(z), 4) AS std_z, round(avg(observed), 6) AS mean_observed, count(DISTINCT slice_id) AS n_slices FROM scores GROUP BY ALL")
def x4_exact_2d(d):
    out = S.over_slices(S.exact_interactions(d.fx_cells, ["cx", "cy"], keys=SLICE))
    return out.withColumns({c: F.round(c, n) for c, n in (("mean_z", 4), ("std_z", 4), ("mean_observed", 6))})


@query(f"WITH {_exact('core', ' + (a.cz - b.cz) ** 2')} SELECT core, src_type, tgt_type, {ROUNDED} FROM scores")
def x5_exact_3d(d):
    return rounded(S.exact_interactions(d.fx_cells.withColumn("cz", F.col("slice_id") * 4.5), ["cx", "cy", "cz"]))


@query(f"WITH {_exact('core', '')} SELECT core, src_type, {ROUNDED} FROM scores WHERE tgt_type = 'error'")
def x6_exact_proximity(d):
    return rounded(S.proximity_to(S.exact_interactions(d.fx_cells, ["cx", "cy"]), "error"))


def hulls(d):
    return A.hull_measure(d.fx_cells, ["cx", "cy"], SLICE, "area")


SIDE = "(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
_side = lambda p, q, r: SIDE.format(p=p, q=q, r=r)

#: Points strictly inside the quadrilateral of the extremes of x + y and x - y are no corners; a pair of the others is a side
#: of the hull if no other lies to its right, nor on its line beyond its ends. The sides' cross products are twice the area.
HULL = f"""pts AS (SELECT DISTINCT core, slice_id, cx::BIGINT AS x, cy::BIGINT AS y FROM fx_cells),
far AS (SELECT core, slice_id, arg_min(x, (x + y, x)) AS ax, arg_min(y, (x + y, x)) AS ay, arg_max(x, (x - y, x)) AS bx, arg_max(y, (x - y, x)) AS by,
  arg_max(x, (x + y, x)) AS cx, arg_max(y, (x + y, x)) AS cy, arg_min(x, (x - y, x)) AS dx, arg_min(y, (x - y, x)) AS dy FROM pts GROUP BY 1, 2),
rim AS (SELECT core, slice_id, x, y FROM pts p JOIN far f USING (core, slice_id) WHERE least({", ".join(_side(f"f.{a}", f"f.{b}", "p.") for a, b in ("ab", "bc", "cd", "da"))}) <= 0),
sides AS (SELECT p.core AS core, p.slice_id AS slice_id, p.x * q.y - p.y * q.x AS twice FROM rim p JOIN rim q ON p.core = q.core AND p.slice_id = q.slice_id AND (p.x <> q.x OR p.y <> q.y)
  WHERE NOT EXISTS (SELECT 1 FROM rim r WHERE r.core = p.core AND r.slice_id = p.slice_id AND ({_side("p.", "q.", "r.")} < 0
    OR {_side("p.", "q.", "r.")} = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0)))"""


@query(f"WITH {HULL} SELECT core, slice_id, sum(twice)::DOUBLE / 2 AS area FROM sides GROUP BY 1, 2")
def a9_hull_area(d):
    """Convex hull of the cells of each section."""
    return hulls(d).withColumn("area", F.round("area", 3))


@query()
def a9_hull_volume(d):
    cells = d.fx_cells.withColumn("cz", F.col("slice_id") * 4.5)
    return A.hull_measure(cells, ["cx", "cy", "cz"], ["core"], "volume").withColumn("volume", F.round("volume", 1))


BOX = "box AS (SELECT core, slice_id, (max(cx) - min(cx)) * (max(cy) - min(cy)) / 1e6::DOUBLE AS area FROM fx_cells GROUP BY 1, 2)"
DENSE = f"""{BOX}, kinds AS (SELECT DISTINCT core, cell_type FROM fx_cells), n AS (SELECT core, slice_id, cell_type, count(*) AS n FROM fx_cells GROUP BY 1, 2, 3),
dens AS (SELECT b.core AS core, b.slice_id AS slice_id, k.cell_type AS cell_type, coalesce(n, 0) / area AS d FROM box b JOIN kinds k ON k.core = b.core LEFT JOIN n ON n.core = b.core AND n.slice_id = b.slice_id AND n.cell_type = k.cell_type),
two AS (SELECT core, cell_type, avg(d) AS m, stddev_samp(d) AS s, count(DISTINCT slice_id) AS n FROM dens GROUP BY 1, 2),
three AS (SELECT core, cell_type, count(*) AS n, round(count(*) / 0.02::DOUBLE, 4) AS d FROM fx_cells GROUP BY 1, 2)"""


def density_2d(d):
    span = lambda c: F.max(c) - F.min(c)
    areas = d.fx_cells.groupBy(*SLICE).agg((span("cx") * span("cy") / 1e6).alias("area_mm2"))
    return A.density_2d(d.fx_cells, areas)


def density_3d(d):
    volumes = d.fx_cells.select("core").distinct().withColumn("volume_mm3", F.lit(0.02))
    return A.density_3d(d.fx_cells, volumes)


@query(f"WITH {DENSE} SELECT core, cell_type, round(m, 4) AS mean_density_per_mm2, round(s, 4) AS std_density_per_mm2, n AS n_slices FROM two")
def a7_density_2d(d):
    return density_2d(d).withColumns({c: F.round(c, 4) for c in ("mean_density_per_mm2", "std_density_per_mm2")})


@query(f"WITH {DENSE} SELECT core, cell_type, n AS n_cells, 0.02::DOUBLE AS volume_mm3, d AS density_per_mm3 FROM three")
def a8_density_3d(d):
    return density_3d(d)


@query(f"""WITH {DENSE} SELECT core, cell_type, round(m * 100 / sum(m) OVER (PARTITION BY core), 6) AS pct_2d, round(d * 100 / sum(d) OVER (PARTITION BY core), 6) AS pct_3d,
  round(d * 100 / sum(d) OVER (PARTITION BY core) - m * 100 / sum(m) OVER (PARTITION BY core), 6) AS delta_pct FROM two JOIN three USING (core, cell_type)""")
def a30_composition_pct(d):
    out = A.composition_pct(density_2d(d), density_3d(d))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_2d", "pct_3d", "delta_pct")})
