"""Queries over marker intensities: histograms, thresholds and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import aggregate as A
from lamella.operators import threshold as T
from lamella.operators.lineage import cut
from lamella.plans.base import query

KEYS = ["core", "slice_id", "marker"]

HIST = """ends AS (SELECT core, slice_id, marker, min(mean) AS lo, max(mean) AS hi FROM fx_markers GROUP BY 1, 2, 3),
hist AS (SELECT core, slice_id, marker, least(floor((mean - lo) / (hi - lo) * {bins}), {bins} - 1)::INTEGER AS bin, count(*) AS n, first(lo) AS lo, first(hi) AS hi
  FROM fx_markers JOIN ends USING (core, slice_id, marker) GROUP BY 1, 2, 3, 4)"""
OTSU = HIST.format(bins=256) + """,
cum AS (SELECT *, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS c FROM hist),
run AS (SELECT *, sum(n) OVER g AS t, sum(n * c) OVER g AS m, sum(n) OVER u AS w0, sum(n * c) OVER u AS m0 FROM cum
  WINDOW g AS (PARTITION BY core, slice_id, marker), u AS (PARTITION BY core, slice_id, marker ORDER BY bin ROWS UNBOUNDED PRECEDING)),
var AS (SELECT *, round(CASE WHEN t > w0 THEN w0::DOUBLE * (t - w0) * (m0 / w0 - (m - m0) / (t - w0)) ** 2 ELSE 0 END / (t::DOUBLE * t), 12) AS v FROM run),
pick AS (SELECT *, row_number() OVER (PARTITION BY core, slice_id, marker ORDER BY v DESC, bin) AS r FROM var),
otsu AS (SELECT core, slice_id, marker, c AS threshold FROM pick WHERE r = 1)"""
FLOOR = """half AS (SELECT core, slice_id, marker, median(mean) AS half FROM fx_markers GROUP BY 1, 2, 3),
low AS (SELECT m.* FROM fx_markers m JOIN half USING (core, slice_id, marker) WHERE mean < half),
centre AS (SELECT core, slice_id, marker, median(mean) AS med FROM low GROUP BY 1, 2, 3),
flo AS (SELECT core, slice_id, marker, first(med) + 3 * median(abs(mean - med)) AS floor FROM low JOIN centre USING (core, slice_id, marker) GROUP BY 1, 2, 3)"""
CEIL = "CASE marker WHEN 'NFP' THEN 0.5::DOUBLE WHEN 'CK' THEN 0.98::DOUBLE WHEN 'CD31' THEN 0.85::DOUBLE WHEN 'GAP43' THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END"


@query("WITH " + HIST.format(bins=40) + " SELECT core, slice_id, marker, bin, n FROM hist")
def a26_histogram(d):
    return A.histogram(d.fx_markers, "mean", 40, KEYS).select(*KEYS, "bin", "n")


@query(f"WITH {OTSU} SELECT core, slice_id, marker, round(threshold, 6) AS threshold FROM otsu")
def t1_otsu(d):
    return T.otsu(d.fx_markers, "mean", KEYS).select(*KEYS, F.round("threshold", 6).alias("threshold"))


@query("WITH " + HIST.format(bins=64) + """,
pk AS (SELECT core, slice_id, marker, first(lo) AS lo, first(hi) AS hi, arg_max(bin, (n, -bin)) AS p, max(n) AS h, min(bin) AS a, max(bin) AS b FROM hist GROUP BY 1, 2, 3),
fr AS (SELECT *, CASE WHEN b - p >= p - a THEN b ELSE a END AS e FROM pk),
sp AS (SELECT *, unnest(range(least(p, e), greatest(p, e) + 1))::INTEGER AS bin FROM fr),
dp AS (SELECT s.*, round(coalesce(h + (x.n - h) * (s.bin - p)::DOUBLE / nullif(e - p, 0) - coalesce(y.n, 0), 0), 9) AS below FROM sp s
  JOIN hist x ON x.core = s.core AND x.slice_id = s.slice_id AND x.marker = s.marker AND x.bin = s.e
  LEFT JOIN hist y ON y.core = s.core AND y.slice_id = s.slice_id AND y.marker = s.marker AND y.bin = s.bin),
rk AS (SELECT *, row_number() OVER (PARTITION BY core, slice_id, marker ORDER BY below DESC, abs(bin - p)) AS r FROM dp)
SELECT core, slice_id, marker, round(lo + (bin + 0.5::DOUBLE) * (hi - lo) / 64, 6) AS threshold FROM rk WHERE r = 1""")
def t2_triangle_threshold(d):
    return T.triangle_threshold(d.fx_markers, "mean", KEYS, 64).select(*KEYS, F.round("threshold", 6).alias("threshold"))


@query(f"WITH {FLOOR} SELECT core, slice_id, marker, round(floor, 6) AS floor FROM flo")
def t3_mad_floor(d):
    return T.mad_floor(d.fx_markers, "mean", KEYS).select(*KEYS, F.round("floor", 6).alias("floor"))


def _density(weight: str, mu: str, var: str) -> str:
    return f"(ln(greatest({weight}, 1e-300::DOUBLE)) - 0.5::DOUBLE * (ln(2 * pi() * {var}) + (x - {mu}) ** 2 / {var}))"


#: Expectation and maximisation of all groups and starts as a recursion: a row of the recursion is a group's mixture after a round.
MIXTURES = f"""RECURSIVE xs AS MATERIALIZED (SELECT core, marker, mean::DOUBLE AS x FROM fx_markers WHERE mean IS NOT NULL),
whole AS (SELECT core, marker, count(*) AS n, avg(x) AS m, greatest(var_pop(x), 1e-6::DOUBLE) AS v, quantile_cont(x, [0.5::DOUBLE, 0.25::DOUBLE, 0.75::DOUBLE, 0.1::DOUBLE, 0.9::DOUBLE]) AS h FROM xs GROUP BY 1, 2),
starts AS (SELECT *, h[i] AS half FROM (SELECT *, unnest(range(1, 6)) AS i FROM whole)),
halves AS (SELECT core, marker, i, any_value(n) AS n, any_value(m) AS m, any_value(v) AS v, avg(x) FILTER (x <= half) AS low, avg(x) FILTER (x > half) AS high, avg((x <= half)::INTEGER::DOUBLE) AS w FROM xs JOIN starts USING (core, marker) GROUP BY 1, 2, 3),
em AS (SELECT core, marker, i, n, w AS w1, coalesce(low, m) AS mu1, v AS v1, 1 - w AS w2, coalesce(high, m) AS mu2, v AS v2, NULL::DOUBLE AS ll, 0 AS rounds, false AS done FROM halves
  UNION ALL SELECT core, marker, i, n, s1 / n, mu1 + a1 / s1, greatest(q1 / s1 - (a1 / s1) ** 2, 1e-6::DOUBLE), s2 / n, mu2 + a2 / s2, greatest(q2 / s2 - (a2 / s2) ** 2, 1e-6::DOUBLE), new, rounds + 1, coalesce(abs(new - old) < 1e-3::DOUBLE, false)
  FROM (SELECT core, marker, i, n, mu1, mu2, rounds, ll AS old, avg(mix) AS new, greatest(sum(r), 1e-12::DOUBLE) AS s1, greatest(sum(1 - r), 1e-12::DOUBLE) AS s2, sum(r * (x - mu1)) AS a1, sum((1 - r) * (x - mu2)) AS a2,
      sum(r * (x - mu1) ** 2) AS q1, sum((1 - r) * (x - mu2) ** 2) AS q2
    FROM (SELECT *, exp(l1 - mix) AS r FROM (SELECT *, greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))) AS mix
      FROM (SELECT e.*, x, {_density("w1", "mu1", "v1")} AS l1, {_density("w2", "mu2", "v2")} AS l2 FROM em e JOIN xs USING (core, marker) WHERE NOT done AND rounds < 100)))
    GROUP BY core, marker, i, n, mu1, mu2, rounds, ll)),
ended AS (SELECT *, row_number() OVER (PARTITION BY core, marker, i ORDER BY rounds DESC) AS last FROM em),
ranked AS (SELECT *, row_number() OVER (PARTITION BY core, marker ORDER BY round(ll, 9) DESC, i) AS place FROM ended WHERE last = 1),
gmm AS (SELECT core, marker, r.n AS n, rounds, done AS converged, w1, mu1, v1, w2, mu2, v2, w.n * (ln(2 * pi() * v) + 1) + 2 * ln(w.n) AS bic1, -2 * ll * r.n + 5 * ln(r.n) AS bic2 FROM ranked r JOIN whole w USING (core, marker) WHERE place = 1)"""
NAMES = ("w1", "mu1", "v1", "w2", "mu2", "v2", "bic1", "bic2")


@query(f"WITH {MIXTURES} SELECT core, marker, n, rounds, converged, {', '.join(f'round({c}, 4) AS {c}' for c in NAMES)} FROM gmm")
def t4_gmm_1d(d):
    """Mixtures of all cores and markers."""
    out = T.gmm_1d(d.fx_markers, "mean", ["core", "marker"])
    return out.select("core", "marker", "n", "rounds", "converged", *[F.round(c, 4).alias(c) for c in NAMES])


MIXES = "mixes AS (SELECT core, slice_z, 0.3::DOUBLE + (slice_z % 5) / 20.0::DOUBLE AS w1, 1.0::DOUBLE AS mu1, 0.5::DOUBLE AS v1, 0.7::DOUBLE - (slice_z % 5) / 20.0::DOUBLE AS w2, 3.0::DOUBLE + core / 10.0::DOUBLE AS mu2, 0.5::DOUBLE AS v2 FROM (SELECT DISTINCT core, slice_z FROM fx_regstats))"


@query(f"WITH {MIXES} SELECT core, slice_z, round(CASE WHEN x BETWEEN mu1 AND mu2 THEN x ELSE (mu1 + mu2) / 2 END, 6) AS cut FROM (SELECT *, (mu1 + mu2) / 2 - v1 * ln(w2 / w1) / (mu2 - mu1) AS x FROM mixes)")
def t5_gmm_cut(d):
    c = F.col
    mixes = d.fx_regstats.select("core", "slice_z").distinct().select(
        "core", "slice_z", (0.3 + c("slice_z") % 5 / 20.0).alias("w1"), F.lit(1.0).alias("mu1"), F.lit(0.5).alias("v1"), (0.7 - c("slice_z") % 5 / 20.0).alias("w2"), (3.0 + c("core") / 10.0).alias("mu2"), F.lit(0.5).alias("v2")
    )
    return T.gmm_cut(mixes).select("core", "slice_z", F.round("cut", 6).alias("cut"))


#: The same texts for a core's markers, all sections together.
OTSU_CORE = OTSU.replace("core, slice_id, marker", "core, marker").replace("GROUP BY 1, 2, 3, 4", "GROUP BY ALL").replace("GROUP BY 1, 2, 3", "GROUP BY ALL")
CHOSEN = f"""{MIXTURES}, {OTSU_CORE}, sides AS (SELECT *, least(mu1, mu2) AS m, greatest(mu1, mu2) AS p, CASE WHEN mu1 <= mu2 THEN v1 ELSE v2 END AS vm, CASE WHEN mu1 <= mu2 THEN v2 ELSE v1 END AS vp, CASE WHEN mu1 <= mu2 THEN w1 ELSE w2 END AS wm, CASE WHEN mu1 <= mu2 THEN w2 ELSE w1 END AS wp FROM gmm),
curve AS (SELECT *, 0.5::DOUBLE / vp - 0.5::DOUBLE / vm AS qa, m / vm - p / vp AS qb, p * p / (2 * vp) - m * m / (2 * vm) + ln(wm * sqrt(vp) / (wp * sqrt(vm))) AS qc FROM sides),
root AS (SELECT *, CASE WHEN abs(qa) >= 1e-12 AND qb * qb >= 4 * qa * qc THEN (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) END AS r1, CASE WHEN abs(qa) >= 1e-12 AND qb * qb >= 4 * qa * qc THEN (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) END AS r2, CASE WHEN abs(qa) < 1e-12 THEN -qc / qb END AS r3 FROM curve),
cuts AS (SELECT core, marker, bic1 - bic2 AS gain, coalesce(CASE WHEN r1 BETWEEN m AND p THEN r1 END, CASE WHEN r2 BETWEEN m AND p THEN r2 END, CASE WHEN r3 BETWEEN m AND p THEN r3 END, (m + p) / 2) AS cut FROM root),
basics AS (SELECT core, marker, count(mean) AS n, min(mean) AS least, max(mean) AS most, median(mean) AS med, quantile_cont(mean, 0.9::DOUBLE) AS p90, avg((mean >= threshold)::INTEGER) AS share, any_value(threshold) AS otsu, {CEIL} AS ceil FROM fx_markers JOIN otsu USING (core, marker) GROUP BY core, marker),
kinds AS (SELECT *, CASE WHEN n < 4 THEN 'sparse' WHEN most - least <= 1e-8 + 1e-5 * abs(most) THEN 'uniform' WHEN gain IS NULL OR isnan(gain) THEN 'otsu_fallback' WHEN gain > 6 THEN 'gmm_bimodal' WHEN share > ceil THEN 'high_pct_fallback' ELSE 'otsu_unimodal' END AS thresh_type FROM basics LEFT JOIN cuts USING (core, marker))"""


@query(f"WITH {CHOSEN} SELECT core, marker, n, round(CASE thresh_type WHEN 'sparse' THEN med WHEN 'uniform' THEN most WHEN 'gmm_bimodal' THEN cut WHEN 'high_pct_fallback' THEN p90 ELSE otsu END, 4) AS threshold, thresh_type FROM kinds")
def t6_choose_threshold(d):
    """Thresholds and their types per core and marker."""
    out = T.choose_threshold(d.fx_markers, "mean", ["core", "marker"])
    return out.select("core", "marker", "n", F.round("threshold", 4).alias("threshold"), "thresh_type")


GUARD = f"""{OTSU}, {FLOOR}, raised AS (SELECT core, slice_id, marker, greatest(threshold, floor) AS t, floor FROM otsu JOIN flo USING (core, slice_id, marker)),
shares AS (SELECT core, slice_id, marker, first(t) AS t, first(floor) AS floor, avg((mean >= t)::INTEGER) AS share, {CEIL} AS ceil, quantile_cont(mean, [0.02::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.5::DOUBLE]) AS p
  FROM fx_markers JOIN raised USING (core, slice_id, marker) GROUP BY 1, 2, 3),
guarded AS (SELECT core, slice_id, marker, CASE WHEN share > ceil THEN p[CASE ceil WHEN 0.98 THEN 1 WHEN 0.9 THEN 2 WHEN 0.85 THEN 3 ELSE 4 END] ELSE t END AS threshold,
  CASE WHEN share > ceil THEN 'otsu_unimodal_ceiling_corrected' ELSE 'otsu_unimodal' END AS thresh_type FROM shares)"""


def _guarded(d):
    base = cut(T.otsu(d.fx_markers, "mean", KEYS).join(T.mad_floor(d.fx_markers, "mean", KEYS), KEYS).withColumn("thresh_type", F.lit("otsu_unimodal")))
    return T.guard_threshold(d.fx_markers, base, "mean", KEYS)


@query(f"WITH {GUARD} SELECT core, slice_id, marker, round(threshold, 6) AS threshold, thresh_type FROM guarded")
def t7_guard_threshold(d):
    return _guarded(d).select(*KEYS, F.round("threshold", 6).alias("threshold"), "thresh_type")


@query(f"""WITH {GUARD}, agreed AS (SELECT core, marker, median(threshold) AS a FROM fx_markers JOIN guarded USING (core, slice_id, marker) WHERE thresh_type NOT LIKE '%ceiling_corrected%' GROUP BY 1, 2),
sh AS (SELECT core, marker, first(a) AS a, avg((mean >= a)::INTEGER) AS share, {CEIL} AS ceil, quantile_cont(mean, [0.02::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.5::DOUBLE]) AS p FROM fx_markers JOIN agreed USING (core, marker) GROUP BY 1, 2)
SELECT m.cell_id AS cell_id, m.marker AS marker, round(coalesce(CASE WHEN share > ceil THEN p[CASE ceil WHEN 0.98 THEN 1 WHEN 0.9 THEN 2 WHEN 0.85 THEN 3 ELSE 4 END] ELSE a END, threshold), 6) AS threshold,
  (mean >= coalesce(CASE WHEN share > ceil THEN p[CASE ceil WHEN 0.98 THEN 1 WHEN 0.9 THEN 2 WHEN 0.85 THEN 3 ELSE 4 END] ELSE a END, threshold))::INTEGER AS pos
FROM fx_markers m JOIN guarded USING (core, slice_id, marker) LEFT JOIN sh USING (core, marker)""")
def t8_consensus_threshold(d):
    cells = d.fx_markers.join(T.told(_guarded(d)), KEYS)
    return T.consensus_threshold(cells).select("cell_id", "marker", F.round("threshold", 6).alias("threshold"), "pos")


@query("""WITH p AS (SELECT core, marker, quantile_cont(mean, 0.01) AS lo, quantile_cont(mean, 0.99) AS hi FROM fx_markers WHERE mean > 0 GROUP BY 1, 2)
SELECT cell_id, marker, round((least(greatest(mean, lo), hi) - lo) / (hi - lo), 6) AS stretched FROM fx_markers JOIN p USING (core, marker)""")
def t9_percentile_stretch(d):
    out = T.percentile_stretch(d.fx_markers, "mean", ["core", "marker"], scale=1.0, among=F.col("mean") > 0)
    return out.select("cell_id", "marker", F.round("stretched", 6).alias("stretched"))


@query("""WITH e AS (SELECT core, marker, min(mean) AS lo, max(mean) AS hi FROM fx_markers GROUP BY 1, 2)
SELECT cell_id, marker, round((mean - lo) / (hi - lo), 6) AS scaled FROM fx_markers JOIN e USING (core, marker)""")
def t10_minmax_scale(d):
    return T.minmax_scale(d.fx_markers, "mean", ["core", "marker"]).select("cell_id", "marker", F.round("scaled", 6).alias("scaled"))


@query("""WITH e AS (SELECT core, marker, quantile_cont(mean, 0.99) AS p, max(mean) AS hi FROM fx_markers GROUP BY 1, 2)
SELECT cell_id, marker, round(least(greatest(mean / CASE WHEN p < 1 THEN hi ELSE p END * 255, 0), 255), 6) AS scaled FROM fx_markers JOIN e USING (core, marker)""")
def t11_p99_scale(d):
    return T.p99_scale(d.fx_markers, "mean", ["core", "marker"]).select("cell_id", "marker", F.round("scaled", 6).alias("scaled"))


@query("""WITH e AS (SELECT core, marker, max(ln(1 + mean)) AS hi FROM fx_markers GROUP BY 1, 2)
SELECT cell_id, marker, round(sqrt(mean / 255) * 255, 6) AS gamma, round(ln(1 + mean) / hi * 255, 6) AS curved FROM fx_markers JOIN e USING (core, marker)""")
def t12_intensity_curves(d):
    out = T.log_curve(T.gamma_curve(d.fx_markers, "mean", out="gamma"), "mean", ["core", "marker"])
    return out.select("cell_id", "marker", F.round("gamma", 6).alias("gamma"), F.round("curved", 6).alias("curved"))
