"""Thresholds from distributions, for all groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.operators.aggregate import histogram
from lamella.operators.lineage import BROADCAST_GROUPS, broadcast_if_small, cut
from lamella.operators.project import with_params

#: The largest share of positive cells by marker, and for any other marker.
MARKER_MAX_SHARE = {"CD31": 0.85, "GAP43": 0.85, "NFP": 0.50, "CD3": 0.90, "CD163": 0.90, "CK": 0.98}
OTHER_MAX_SHARE = 0.90
BIC_THRESHOLD = 6.0


def told(groups: DataFrame) -> DataFrame:
    """A row for each group, computed once and sent to the cells: cells neither move nor are sorted for it."""
    return broadcast_if_small(cut(groups), BROADCAST_GROUPS)


def percentiles(df: DataFrame, value: str, keys: Sequence[str], levels: Sequence[float], out: str = "_p", accuracy: int = 2000, chosen: DataFrame | None = None) -> DataFrame:
    """Exact percentiles per group, between two values in proportion: (keys, ``out``), an array in the order of ``levels``.

    A first pass brackets each level by approximate percentiles, whose rank is off by one in ``accuracy`` at most and which
    are merged from small summaries. A second pass counts the values below and above a bracket, keeping the one next to
    it, and each value within it, about four in ``accuracy`` of a group: no task ever holds a group's values. Nulls and
    NaN do not count. ``chosen(keys, j)`` asks only for its groups, and for one level of each, the ``j``-th.
    """
    keys = [*keys]
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    margin = 2.0 / accuracy
    ends = [p for level in levels for p in (max(0.0, level - margin), min(1.0, level + margin))]
    asked = [F.lit(j) for j in range(len(levels))]
    if chosen is not None:
        asked, rows = [F.col("j")], rows.join(told(chosen.select(*keys, "j")), keys)
    rough = told(rows.groupBy(*keys, *(["j"] if chosen is not None else [])).agg(F.percentile_approx("_x", ends, accuracy).alias("_q"), F.count("*").alias("_n")))
    x, none = F.col("_x"), F.lit(None).cast("double")
    end = lambda j: F.get("_q", j)
    inside = reduce(lambda p, q: p | q, [x.between(end(2 * j), end(2 * j + 1)) for j in asked])
    # Values outside of all brackets are counted in one row a group, before any level has rows of its own.
    outside = [f(j).alias(f"_{c}{i}") for i, j in enumerate(asked) for c, f in (("c", lambda j: F.count_if(x < end(2 * j))), ("lo", lambda j: F.max(F.when(x < end(2 * j), x))), ("hi", lambda j: F.min(F.when(x > end(2 * j + 1), x))))]
    values = rows.drop("j").join(rough, keys).withColumn("_v", F.when(inside, x)).groupBy(*keys, "_v").agg(F.count("*").alias("_all"), *outside).join(rough, keys)
    zone = lambda j: F.when(F.col("_v") < end(2 * j), 0).when(F.col("_v") <= end(2 * j + 1), 1).otherwise(2)
    part = lambda j, where, v, least, most, c: F.struct(j.alias("j"), where.alias("zone"), v.alias("v"), least.alias("least"), most.alias("most"), c.alias("c"))
    v, whole = F.col("_v"), F.col("_all")
    places = [part(j, zone(j), F.when(zone(j) == 1, v), v, v, F.when(v.isNotNull(), whole).otherwise(0)) for j in asked]
    for i, j in enumerate(asked):
        below = F.when(v.isNull(), F.col(f"_c{i}")).otherwise(0)
        places.append(part(j, F.lit(0), none, F.col(f"_lo{i}"), F.col(f"_lo{i}"), below))
        places.append(part(j, F.lit(2), none, F.col(f"_hi{i}"), F.col(f"_hi{i}"), F.when(v.isNull(), whole - F.col(f"_c{i}")).otherwise(0)))
    placed = values.select(*keys, "_n", F.explode(F.array(*places)).alias("_at")).filter("_at.c > 0")
    counts = placed.groupBy(*keys, "_n", "_at.j", "_at.zone", "_at.v").agg(F.sum("_at.c").alias("_c"), F.min("_at.least").alias("_least"), F.max("_at.most").alias("_most"))
    counts = counts.withColumn("v", F.when(F.col("zone") == 0, F.col("_most")).otherwise(F.col("_least")))
    upto = Window.partitionBy(*keys, "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.get(F.array(*map(F.lit, map(float, levels))), F.col("j")) * (F.col("_n") - 1)
    ranked = counts.withColumns({"_cum": F.sum("_c").over(upto), "_rank": rank})
    at = lambda i: F.min(F.when(F.col("_cum") > i, F.col("v")))
    low = F.floor("_rank")
    two = ranked.groupBy(*keys, "j", "_rank").agg(at(low).alias("_a"), at(F.least(low + 1, F.col("_n") - 1)).alias("_b"))
    found = two.select(*keys, F.struct("j", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))).alias("v")).alias("_v"))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_v")), lambda v: v["v"]).alias(out))


def median_of(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    return percentiles(df, value, keys, [0.5]).select(*keys, F.get("_p", F.lit(0)).alias(out))


def otsu(df: DataFrame, value: str, keys: Sequence[str], bins: int = 256, out: str = "threshold") -> DataFrame:
    """Otsu's threshold per group: the first bin centre of largest between-class variance; a constant group's own value.

    Only filled bins are looked at: between two of them the variance does not change and the first maximum is the filled one.
    """
    keys = [*keys]
    counts = histogram(df, value, bins, keys).withColumn("_c", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    group, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total, moment = F.sum("n").over(group), F.sum(F.col("n") * F.col("_c")).over(group)
    w0, m0 = F.sum("n").over(upto), F.sum(F.col("n") * F.col("_c")).over(upto)
    parts = counts.select(*keys, "bin", "lo", "hi", "_c", total.alias("_t"), moment.alias("_m"), w0.alias("_w0"), m0.alias("_m0"))
    apart = F.col("_m0") / F.col("_w0") - F.try_divide(F.col("_m") - F.col("_m0"), F.col("_t") - F.col("_w0"))
    variance = F.coalesce(F.col("_w0") * (F.col("_t") - F.col("_w0")) * apart * apart, F.lit(0.0)) / (F.col("_t") * F.col("_t"))
    # Rounded, so that a tie in exact arithmetic is one here and goes to the first bin.
    best = parts.withColumn("_v", F.round(variance, 12)).groupBy(*keys).agg(F.max_by("_c", F.struct(F.col("_v"), -F.col("bin"))).alias("_o"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return best.select(*keys, F.when(F.col("hi") > F.col("lo"), F.col("_o")).otherwise(F.col("hi")).alias(out))


def triangle_threshold(df: DataFrame, value: str, keys: Sequence[str], bins: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """Triangle threshold per group: the bin farthest below the chord from the histogram's peak to its farther filled end."""
    keys = [*keys]
    counts = histogram(df, value, bins, keys, low, high)
    ends = counts.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_p"), F.max("n").alias("_h"), F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    right = (F.col("_b") - F.col("_p")) >= (F.col("_p") - F.col("_a"))
    far = F.when(right, F.col("_b")).otherwise(F.col("_a"))
    # All bins between peak and end take part, empty ones too: they are the lowest.
    spans = ends.withColumn("_e", far).select(*keys, "_p", "_h", "_e", F.explode(F.sequence(F.least("_p", "_e"), F.greatest("_p", "_e"))).alias("bin"))
    joined = spans.join(counts.select(*keys, "bin", "n"), [*keys, "bin"], "left").fillna({"n": 0})
    ends_n = counts.select(*keys, F.col("bin").alias("_e"), F.col("n").alias("_en"))
    depth = joined.join(ends_n, [*keys, "_e"])
    chord = F.col("_h") + (F.col("_en") - F.col("_h")) * F.try_divide((F.col("bin") - F.col("_p")).cast("double"), (F.col("_e") - F.col("_p")).cast("double"))
    below = F.round(F.coalesce(chord - F.col("n"), F.lit(0.0)), 9)
    best = depth.groupBy(*keys).agg(F.max_by("bin", F.struct(below, -F.abs(F.col("bin") - F.col("_p")))).alias("bin"))
    bounds = counts.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return best.join(bounds, keys).select(*keys, (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))


def mad_floor(df: DataFrame, value: str, keys: Sequence[str], k: float = 3.0, out: str = "floor") -> DataFrame:
    """Noise floor from the rows below the median: their median plus k median deviations; 0 for fewer than two rows."""
    keys = [*keys]
    counts = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    half = told(counts.join(median_of(df, value, keys, "_half"), keys, "left"))
    low = df.select(*keys, value).join(half, keys).filter(F.col(value) < F.col("_half")).select(*keys, F.col(value).alias("_x"))
    centre = told(median_of(low, "_x", keys, "_med"))
    off = low.join(centre, keys).select(*keys, F.abs(F.col("_x") - F.col("_med")).alias("_off"))
    spread = centre.join(median_of(off, "_off", keys, "_mad"), keys)
    floor = F.when((F.col("_n") < 2) | F.col("_med").isNull(), 0.0).otherwise(F.col("_med") + F.lit(k) * F.col("_mad"))
    return half.join(spread, keys, "left").select(*keys, floor.alias(out))


#: Shares of the rows that the lower component starts from.
STARTS = (0.5, 0.25, 0.75, 0.1, 0.9)


def gmm_1d(df: DataFrame, value: str, keys: Sequence[str], rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6, starts: Sequence[float] = STARTS) -> DataFrame:
    """One- and two-component normal mixtures per group by EM: w1, mu1, v1, w2, mu2, v2, bic1, bic2, n, rounds, converged.

    All groups are fitted together: a step is column arithmetic on the rows joined with their group's parameters and one
    grouped sum; rows never leave their group's partition as the parameters come to them. Groups whose mean
    log-likelihood gains less than ``tolerance`` drop out; ``converged`` is false for those that ``rounds`` end before. Each of ``starts`` splits the rows at that share of them; of
    the mixtures that they lead to, the likeliest is kept.
    """
    groups = [*keys]
    base = df.select(*groups, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    x = F.col("_x")
    base = cut(base)
    whole = base.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_x").alias("_m"), F.greatest(F.var_pop("_x"), F.lit(floor)).alias("_v"))
    splits = told(percentiles(base, "_x", groups, starts, "_h")).select(*groups, F.posexplode("_h").alias("_start", "_half"))
    start = whole.join(splits, groups)
    keys = [*groups, "_start"]
    split = base.join(splits, groups)
    part = lambda f, low: F.avg(F.when((x <= F.col("_half")) == low, f))
    halves = split.groupBy(*keys).agg(part(x, True).alias("mu1"), part(x, False).alias("mu2"), F.avg((x <= F.col("_half")).cast("double")).alias("w1"))
    one = start.withColumn("bic1", F.col("n") * (F.log(2 * F.pi() * F.col("_v")) + 1) + 2 * F.log("n"))
    params = one.join(halves, keys).select(
        *keys, "n", "bic1", F.col("w1"), F.coalesce("mu1", "_m").alias("mu1"), F.col("_v").alias("v1"), (1 - F.col("w1")).alias("w2"), F.coalesce("mu2", "_m").alias("mu2"), F.col("_v").alias("v2"),
        F.lit(None).cast("double").alias("ll"), F.lit(0).alias("rounds"), F.lit(False).alias("done"),
    )
    params = cut(params)
    for _ in range(rounds):
        open_ = params.filter("NOT done")
        if open_.isEmpty():
            break
        # What is the same for all cells of a group is worked out once a group; a cell needs one exponential and one logarithm.
        known = open_.select(*keys, "mu1", "mu2", *[c for i in "12" for c in ((F.log(F.greatest(f"w{i}", F.lit(1e-300))) - 0.5 * F.log(2 * F.pi() * F.col(f"v{i}"))).alias(f"_k{i}"), (0.5 / F.col(f"v{i}")).alias(f"_h{i}"))])
        # Squares about the old means: large values do not cancel.
        rows = base.join(told(known), groups).select(*keys, (x - F.col("mu1")).alias("_d1"), (x - F.col("mu2")).alias("_d2"), "_k1", "_h1", "_k2", "_h2")
        rows = rows.select(*keys, "_d1", "_d2", *[(F.col(f"_k{i}") - F.col(f"_d{i}") * F.col(f"_d{i}") * F.col(f"_h{i}")).alias(f"_l{i}") for i in "12"])
        rows = rows.withColumn("_e", F.exp(-F.abs(F.col("_l1") - F.col("_l2"))))
        rows = rows.select(*keys, "_d1", "_d2", (F.greatest("_l1", "_l2") + F.log1p("_e")).alias("_ll"), (F.when(F.col("_l1") >= F.col("_l2"), 1.0).otherwise(F.col("_e")) / (1 + F.col("_e"))).alias("_r"))
        a, b, r = F.col("_d1"), F.col("_d2"), F.col("_r")
        sums = rows.groupBy(*keys).agg(
            F.avg("_ll").alias("_ll"), F.sum("_r").alias("_s1"), F.sum(1 - r).alias("_s2"),
            F.sum(r * a).alias("_a1"), F.sum((1 - r) * b).alias("_a2"), F.sum(r * a * a).alias("_q1"), F.sum((1 - r) * b * b).alias("_q2"),
        )
        s1, s2 = F.greatest("_s1", F.lit(1e-12)), F.greatest("_s2", F.lit(1e-12))
        d1, d2 = F.col("_a1") / s1, F.col("_a2") / s2
        done = F.coalesce(F.abs(F.col("_ll") - F.col("ll")) < tolerance, F.lit(False))
        moved = open_.join(sums, keys).select(
            *keys, "n", "bic1", (s1 / F.col("n")).alias("w1"), (F.col("mu1") + d1).alias("mu1"), F.greatest(F.col("_q1") / s1 - d1 * d1, F.lit(floor)).alias("v1"),
            (s2 / F.col("n")).alias("w2"), (F.col("mu2") + d2).alias("mu2"), F.greatest(F.col("_q2") / s2 - d2 * d2, F.lit(floor)).alias("v2"),
            F.col("_ll").alias("ll"), (F.col("rounds") + 1).alias("rounds"), done.alias("done"),
        )
        params = cut(params.filter("done").unionByName(moved))
    params = params.withColumnRenamed("done", "converged")
    named = [c for c in params.columns if c not in keys]
    best = params.groupBy(*groups).agg(F.max_by(F.struct(*named), F.struct(F.round("ll", 9), -F.col("_start"))).alias("_best")).select(*groups, "_best.*")
    return best.withColumn("bic2", -2 * F.col("ll") * F.col("n") + 5 * F.log("n"))


def gmm_cut(params: DataFrame) -> DataFrame:
    """Where the two weighted densities cross between the means, from the quadratic; the midpoint if they do not."""
    low = F.col("mu1") <= F.col("mu2")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    named = params.withColumns({"_m": pick("mu1", "mu2"), "_p": pick("mu2", "mu1"), "_vm": pick("v1", "v2"), "_vp": pick("v2", "v1"), "_wm": pick("w1", "w2"), "_wp": pick("w2", "w1")})
    m, p, vm, vp = (F.col(c) for c in ("_m", "_p", "_vm", "_vp"))
    a = 1 / (2 * vp) - 1 / (2 * vm)
    b = m / vm - p / vp
    c = p * p / (2 * vp) - m * m / (2 * vm) + F.log(F.try_divide(F.col("_wm") * F.sqrt(vp), F.col("_wp") * F.sqrt(vm)))
    disc = b * b - 4 * a * c
    roots = [F.when(disc >= 0, F.try_divide(-b + s * F.sqrt(disc), 2 * a)) for s in (1, -1)] + [F.try_divide(-c, b)]
    usable = [F.when((F.abs(a) >= 1e-12) & r.between(m, p), r) for r in roots[:2]] + [F.when((F.abs(a) < 1e-12) & roots[2].between(m, p), roots[2])]
    return named.withColumn("cut", F.coalesce(*usable, (m + p) / 2)).drop("_m", "_p", "_vm", "_vp", "_wm", "_wp")


def choose_threshold(df: DataFrame, value: str, keys: Sequence[str], marker: str = "marker", bic: float = BIC_THRESHOLD, ceilings: Mapping[str, float] = MARKER_MAX_SHARE) -> DataFrame:
    """Threshold and its type per group, ``marker`` being one of the keys.

    Fewer than 4 rows: the median, ``sparse``. Constant: the value, ``uniform``. BIC better by more than ``bic`` for two
    components: their crossing, ``gmm_bimodal``. Otherwise Otsu, or the 90th percentile where Otsu calls more cells
    positive than the marker's ceiling. A mixture without parameters falls back to Otsu.
    """
    keys = [*keys]
    places = percentiles(df, value, keys, [0.5, 0.9]).select(*keys, F.get("_p", F.lit(0)).alias("_med"), F.get("_p", F.lit(1)).alias("_p90"))
    basics = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).join(places, keys)
    flat = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-8 + 1e-5 * F.abs("_hi")
    fitted = gmm_cut(gmm_1d(df, value, keys)).select(*keys, "cut", (F.col("bic1") - F.col("bic2")).alias("_gain"))
    otsus = told(otsu(df, value, keys, out="_otsu"))
    share = df.join(otsus, keys).groupBy(*keys).agg(F.avg((F.col(value) >= F.col("_otsu")).cast("double")).alias("_share"))
    joined = basics.join(otsus, keys).join(share, keys).join(fitted, keys, "left")
    limited = with_params(joined, ceilings, marker, "_max", OTHER_MAX_SHARE)
    kind = (
        F.when(F.col("n") < 4, "sparse")
        .when(flat, "uniform")
        .when(F.col("_gain").isNull() | F.isnan("_gain"), "otsu_fallback")
        .when(F.col("_gain") > bic, "gmm_bimodal")
        .when(F.col("_share") > F.col("_max"), "high_pct_fallback")
        .otherwise("otsu_unimodal")
    )
    by = {"sparse": "_med", "uniform": "_hi", "gmm_bimodal": "cut", "high_pct_fallback": "_p90"}
    value_of = F.col("_otsu")
    for name, column in by.items():
        value_of = F.when(kind == name, F.col(column)).otherwise(value_of)
    return limited.select(*keys, "n", value_of.alias("threshold"), kind.alias("thresh_type"))


def _caps(df: DataFrame, value: str, keys: Sequence[str], shares: DataFrame, ceilings: Mapping[str, float]) -> DataFrame:
    """(keys, _cap) for the groups of ``shares(keys, _share, _max)`` that exceed their ceiling: the percentile that meets it."""
    levels = sorted({*ceilings.values(), OTHER_MAX_SHARE})
    number = reduce(lambda place, i: F.when(F.col("_max") == levels[i], i).otherwise(place), range(len(levels)), F.lit(None).cast("int"))
    chosen = shares.filter(F.col("_share") > F.col("_max")).select(*keys, number.alias("j"))
    return percentiles(df, value, keys, [1 - c for c in levels], chosen=chosen).select(*keys, F.get("_p", F.lit(0)).alias("_cap"))


def guard_threshold(df: DataFrame, thresholds: DataFrame, value: str, keys: Sequence[str], marker: str = "marker", ceilings: Mapping[str, float] = MARKER_MAX_SHARE) -> DataFrame:
    """Thresholds raised to the noise floor, and to a percentile where more cells than the ceiling would be positive.

    ``thresholds(keys, threshold, thresh_type, floor)``.
    """
    keys = [*keys]
    raised = with_params(thresholds.withColumn("_t", F.greatest("threshold", "floor")), ceilings, marker, "_max", OTHER_MAX_SHARE)
    raised = cut(raised)
    shares = df.join(broadcast_if_small(raised.select(*keys, "_t"), BROADCAST_GROUPS), keys).groupBy(*keys).agg(F.avg((F.col(value) >= F.col("_t")).cast("double")).alias("_share"))
    joined = cut(raised.join(shares, keys))
    joined = joined.join(_caps(df, value, keys, joined, ceilings), keys, "left")
    over, cap = F.col("_share") > F.col("_max"), F.col("_cap")
    fixed = F.when(over, cap).otherwise(F.col("_t"))
    kind = F.when(over, F.concat("thresh_type", F.lit("_ceiling_corrected"))).otherwise(F.col("thresh_type"))
    return joined.select(*keys, fixed.alias("threshold"), kind.alias("thresh_type"), "floor")


def consensus_threshold(cells: DataFrame, value: str = "mean", keys: Sequence[str] = ("core", "marker"), marker: str = "marker", ceilings: Mapping[str, float] = MARKER_MAX_SHARE, per_slice: Sequence[str] | None = None) -> DataFrame:
    """One threshold per core and marker for all slices: the median of the reliable ones; positives are called anew.

    ``cells(keys, value, threshold, thresh_type)``, one row a cell and marker. The median is over cells, so large slices
    weigh more; with ``per_slice`` (the keys of a slice) it is over slices. Without a reliable threshold the old ones stay.
    """
    keys = [*keys]
    reliable = cells.filter(~F.col("thresh_type").rlike("ceiling_corrected|singular_fallback|sparse|uniform"))
    if per_slice:
        reliable = reliable.select(*dict.fromkeys([*keys, *per_slice]), "threshold").distinct()
    agreed = told(reliable.groupBy(*keys).agg(F.median("threshold").alias("_agreed")))
    shares = cells.join(agreed, keys).groupBy(*keys).agg(F.avg((F.col(value) >= F.col("_agreed")).cast("double")).alias("_share"), F.first("_agreed").alias("_agreed"))
    limits = cut(with_params(shares, ceilings, marker, "_max", OTHER_MAX_SHARE))
    limits = told(limits.join(_caps(cells, value, keys, limits, ceilings), keys, "left"))
    joined = cells.join(limits, keys, "left")
    over, cap = F.coalesce(F.col("_share") > F.col("_max"), F.lit(False)), F.col("_cap")
    new = F.when(F.col("_agreed").isNull(), F.col("threshold")).when(over, cap).otherwise(F.col("_agreed"))
    kind = F.when(over & ~F.contains(F.col("thresh_type"), F.lit("ceiling")), F.concat("thresh_type", F.lit("_consensus_ceiling"))).otherwise(F.col("thresh_type"))
    out = joined.withColumns({"thresh_raw": F.col("threshold"), "_new": new, "_kind": kind})
    return out.withColumns({"threshold": F.col("_new"), "thresh_type": F.col("_kind"), "pos": (F.col(value) >= F.col("_new")).cast("int")}).drop("_new", "_kind", "_agreed", "_max", "_share", "_cap")


def percentile_stretch(df: DataFrame, value: str, keys: Sequence[str], low: float = 0.01, high: float = 0.99, scale: float = 255.0, among: Column | None = None, out: str = "stretched") -> DataFrame:
    """Values clipped to two percentiles of their group (of the rows ``among``) and rescaled to 0..``scale``; truncated at 255."""
    keys = [*keys]
    seen = df if among is None else df.filter(among)
    ends = told(percentiles(seen, value, keys, [low, high]))
    lo, hi = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    part = F.try_divide(F.least(F.greatest(F.col(value), lo), hi) - lo, hi - lo)
    made = F.coalesce(part, F.lit(0.0)) * F.lit(scale)
    return df.join(ends, keys).withColumn(out, F.floor(made).cast("int") if scale == 255.0 else made).drop("_p")


def minmax_scale(df: DataFrame, value: str, keys: Sequence[str], out: str = "scaled") -> DataFrame:
    """Values as their place between the group's extremes; a constant group stays as it is."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    made = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return df.join(ends, [*keys]).withColumn(out, made).drop("_lo", "_hi")


def p99_scale(df: DataFrame, value: str, keys: Sequence[str], out: str = "scaled") -> DataFrame:
    """Values over the group's 99th percentile as 0..255; the maximum stands in for a percentile below 1."""
    at = percentiles(df, value, keys, [0.99]).select(*keys, F.get("_p", F.lit(0)).alias("_p"))
    tops = df.groupBy(*keys).agg(F.max(value).alias("_hi")).join(at, keys)
    top = F.when(F.col("_p") < 1, F.col("_hi")).otherwise(F.col("_p"))
    made = F.least(F.greatest(F.try_divide(F.col(value), top) * 255.0, F.lit(0.0)), F.lit(255.0))
    return df.join(tops, [*keys]).withColumn(out, made).drop("_p", "_hi")


def gamma_curve(df: DataFrame, value: str, gamma: float = 0.5, top: float = 255.0, out: str = "curved") -> DataFrame:
    return df.withColumn(out, F.pow(F.col(value) / top, F.lit(gamma)) * top)


def log_curve(df: DataFrame, value: str, keys: Sequence[str], out: str = "curved") -> DataFrame:
    """log1p stretched to 0..255 by the group's maximum."""
    tops = df.groupBy(*keys).agg(F.max(F.log1p(value)).alias("_top"))
    return df.join(tops, [*keys]).withColumn(out, F.coalesce(F.try_divide(F.log1p(value), F.col("_top")), F.lit(0.0)) * 255.0).drop("_top")
