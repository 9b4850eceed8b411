"""Queries over overlap graphs: linking sections into 3-D cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import aggregate as A
from lamella.operators import graph as G
from lamella.operators import joins as J
from lamella.operators import runs as R
from lamella.plans.base import query

EDGES = """ov AS (SELECT a.core AS core, a.slice_z AS z, a.label AS label_a, b.label AS label_b, count(*) AS n_shared FROM fx_mask a JOIN fx_mask b ON a.core = b.core AND b.slice_z = a.slice_z + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3, 4),
ar AS (SELECT core, slice_z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM fx_mask GROUP BY 1, 2, 3),
edges AS (SELECT o.core AS core, o.z AS z, label_a, label_b, n_shared, n_shared::DOUBLE / least(p.area, q.area) AS frac FROM ov o JOIN ar p ON p.core = o.core AND p.slice_z = o.z AND p.label = label_a
  JOIN ar q ON q.core = o.core AND q.slice_z = o.z + 1 AND q.label = label_b WHERE n_shared >= 1 AND n_shared::DOUBLE / least(p.area, q.area) >= 0.1::DOUBLE)"""


def edges(d):
    return J.overlap_edges(d.fx_mask, min_overlap=1, min_frac=0.1)


def stats(d):
    return A.label_stats(d.fx_mask).withColumnRenamed("slice_z", "z")


@query(f"WITH {EDGES} SELECT core, z, label_a, label_b, n_shared, round(frac, 6) AS frac FROM edges")
def j4_overlap_edges(d):
    return edges(d).withColumn("frac", F.round("frac", 6))


@query(f"WITH {EDGES} SELECT core, z, label_a, label_b, n_shared, round(frac, 6) AS frac FROM edges")
def j4_overlap_runs(d):
    """The same from runs."""
    return R.run_overlaps(R.runs_of_pixels(d.fx_mask), min_overlap=1, min_frac=0.1).withColumn("frac", F.round("frac", 6))


#: A label's place as one number, without collisions below 2^17 cores, 2^14 sections and 2^32 labels.
NODE = "(({core} * 16384 + {z}) * 4294967296 + {label})"
#: The core of a node, read off its number.
CORE = "shiftright(node, 46)"


def node_id(core: str, z: str, label: str):
    return F.expr(NODE.format(core=f"CAST({core} AS BIGINT)", z=z, label=label))


def graph(d):
    nodes = stats(d).select("core", "z", "label", node_id("core", "z", "label").alias("node"), "area_px", "centroid_y", "centroid_x")
    lines = edges(d).select(node_id("core", "z", "label_a").alias("a"), node_id("core", "(z + 1)", "label_b").alias("b"), F.col("n_shared").alias("weight"))
    return nodes, lines


def _reach(r: int) -> str:
    """SQL of components over the edges ``e{r}``: all that a node reaches, the smallest naming it."""
    return f"""w{r} AS (SELECT a, b FROM e{r} UNION ALL SELECT b, a FROM e{r}),
r{r} AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r{r}.a, w{r}.b FROM r{r} JOIN w{r} ON w{r}.a = r{r}.b),
c{r} AS MATERIALIZED (SELECT a AS node, min(b) AS component FROM r{r} GROUP BY 1)"""


def _sever(r: int, most: int) -> str:
    """SQL of the edges that are left after the lightest ones of every component longer than ``most`` sections are cut."""
    return f"""s{r} AS (SELECT component FROM c{r} JOIN nodes USING (node) GROUP BY 1 HAVING max(z) - min(z) + 1 > {most}),
l{r} AS (SELECT component, min(weight) AS least FROM e{r} JOIN c{r} ON node = a JOIN s{r} USING (component) GROUP BY 1),
e{r + 1} AS MATERIALIZED (SELECT a, b, weight FROM e{r} JOIN c{r} ON node = a LEFT JOIN l{r} USING (component) WHERE least IS NULL OR weight > least)"""


NODES = f"""RECURSIVE {EDGES}, nodes AS MATERIALIZED (SELECT {NODE.format(core="core", z="slice_z", label="label")} AS node, core, slice_z AS z FROM ar),
e0 AS MATERIALIZED (SELECT {NODE.format(core="core", z="z", label="label_a")} AS a, {NODE.format(core="core", z="(z + 1)", label="label_b")} AS b, n_shared AS weight FROM edges), {_reach(0)}"""
#: Labels of the views cover four pixels and share one to four with the next section, so four cuts leave no edge to cut.
CUTS = 4
SEVERED = ", ".join([NODES, *(part for r in range(CUTS) for part in (_sever(r, 5), _reach(r + 1)))])


@query(f"WITH {NODES} SELECT node, component FROM c0")
def g2_connected_components(d):
    nodes, lines = graph(d)
    return G.connected_components(nodes, lines)


@query(f"WITH {SEVERED} SELECT node, component FROM c{CUTS}")
def g3_sever_components(d):
    """Components of at most five sections."""
    nodes, lines = graph(d)
    return G.sever_components(nodes, lines, 5)


@query(f"WITH {SEVERED}, f AS (SELECT core, component, min(node) AS first FROM c{CUTS} JOIN nodes USING (node) GROUP BY 1, 2), k AS (SELECT core, component, row_number() OVER (PARTITION BY core ORDER BY first) AS cell_id_3d FROM f) SELECT core, node, component, cell_id_3d FROM c{CUTS} JOIN nodes USING (node) JOIN k USING (core, component)")
def g4_assign_cell_ids(d):
    nodes, lines = graph(d)
    labels = G.sever_components(nodes, lines, 5).withColumn("core", F.expr(CORE))
    return G.assign_cell_ids(labels)


LINKS = f"""{EDGES}, mem AS (SELECT core, label AS cell_id_3d, slice_z AS z, label FROM ar),
nx AS (SELECT core, cell_id_3d, z AS z_a, label AS label_a, lead(z) OVER w AS z_b, lead(label) OVER w AS label_b FROM mem WINDOW w AS (PARTITION BY core, cell_id_3d ORDER BY z, label)),
links AS (SELECT n.core AS core, n.cell_id_3d AS cell_id_3d, z_a, n.label_a AS label_a, z_b, n.label_b AS label_b, coalesce(e.n_shared, 0) AS n_shared, p.area AS aa, q.area AS ab, p.cx AS xa, q.cx AS xb, p.cy AS ya, q.cy AS yb
  FROM nx n LEFT JOIN edges e ON e.core = n.core AND e.z = n.z_a AND e.z + 1 = n.z_b AND e.label_a = n.label_a AND e.label_b = n.label_b
  JOIN ar p ON p.core = n.core AND p.slice_z = n.z_a AND p.label = n.label_a JOIN ar q ON q.core = n.core AND q.slice_z = n.z_b AND q.label = n.label_b WHERE z_b IS NOT NULL)"""
IDS = ["core", "cell_id_3d", "z_a", "label_a", "z_b", "label_b"]


def members(d):
    """Every label is followed through the sections of its core."""
    return stats(d).select("core", F.col("label").alias("cell_id_3d"), "z", "label")


def links(d):
    return J.consecutive_links(members(d), edges(d))


@query(f"WITH {LINKS} SELECT core, cell_id_3d, z_a, label_a, z_b, label_b, n_shared FROM links")
def j16_consecutive_links(d):
    return links(d)


@query(f"WITH {LINKS} SELECT core, cell_id_3d, z_a, label_a, z_b, label_b, round(n_shared::DOUBLE / least(aa, ab), 6) AS overlap_fraction, n_shared::DOUBLE / least(aa, ab) < 0.1::DOUBLE AS weak FROM links")
def g5_link_overlap_qc(d):
    return G.link_overlap_qc(links(d), stats(d)).select(*IDS, F.round("overlap_fraction", 6).alias("overlap_fraction"), "weak")


@query(f"WITH {LINKS} SELECT core, cell_id_3d, z_a, label_a, z_b, label_b, round(sqrt((xb - xa) ** 2 + (yb - ya) ** 2), 6) AS drift_px, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) > 0.4::DOUBLE AS flagged FROM links")
def g6_link_drift_qc(d):
    return G.link_drift_qc(links(d), stats(d), flag=0.4).select(*IDS, F.round("drift_px", 6).alias("drift_px"), "flagged")


@query(f"WITH {LINKS} SELECT core, cell_id_3d, z_a, label_a, z_b, label_b, round(greatest(aa, ab)::DOUBLE / least(aa, ab), 6) AS area_ratio, greatest(aa, ab)::DOUBLE / least(aa, ab) > 3 AS flagged FROM links")
def g7_link_area_qc(d):
    return G.link_area_qc(links(d), stats(d)).select(*IDS, F.round("area_ratio", 6).alias("area_ratio"), "flagged")


SPANS = "feat AS (SELECT core, cluster_id, max(slice_id) - min(slice_id) + 1 AS span FROM fx_cells GROUP BY 1, 2)"


def features(d):
    cells = d.fx_cells.select("core", F.col("cluster_id").alias("cell_id_3d"), F.col("slice_id").alias("z"), "slice_id", F.lit(20).alias("area_px"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"))
    return A.cell3d_features(cells)


@query(f"WITH {SPANS} SELECT core, span AS z_span_slices, count(*) AS n_cells FROM feat GROUP BY 1, 2")
def g8_span_distribution(d):
    return G.span_distribution(features(d))


@query(f"WITH {SPANS} SELECT core, count(*) AS n_cells, sum((span >= 2)::INTEGER)::BIGINT AS n_confirmed, sum((span = 1)::INTEGER)::BIGINT AS n_singletons, round(avg(span), 6) AS mean_span FROM feat GROUP BY 1")
def g8_linking_summary(d):
    return G.linking_summary(features(d)).withColumn("mean_span", F.round("mean_span", 6))


@query("WITH g AS (SELECT core, cluster_id, slice_id, count(*) - 1 AS extra FROM fx_cells GROUP BY 1, 2, 3) SELECT core, sum(extra)::BIGINT AS n_dropped FROM g GROUP BY 1")
def g9_dedupe_members(d):
    rows = d.fx_cells.select("core", F.col("cluster_id").alias("cell_id_3d"), F.col("slice_id").alias("z"), F.lit(1).alias("label"))
    return G.dedupe_members(rows)[1]


@query("SELECT DISTINCT core, cluster_id AS cell_id_3d, slice_id AS z FROM fx_cells")
def g9_unique_members(d):
    rows = d.fx_cells.select("core", F.col("cluster_id").alias("cell_id_3d"), F.col("slice_id").alias("z"), F.lit(1).alias("label"))
    return G.dedupe_members(rows)[0].drop("label")
