"""Row-wise operators: units, typing, gates and affine algebra. None of them shuffles, but for joins to group aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.scalars import MARKERS, PIXEL_UM, SECTION_UM, clip, ratio

#: Cell types in the order in which they are tried; each but the first needs CK to be negative.
CODEBOOK = (
    ("Tumour", ("pos_CK",), False),
    ("T_cell", ("pos_CD3",), True),
    ("Macrophage", ("pos_CD163",), True),
    ("Endothelial", ("pos_CD31",), True),
    ("Neural", ("pos_GAP43", "pos_NFP"), True),
)
UNKNOWN = "Unknown"


def to_microns(df: DataFrame, areas: Sequence[str] = (), lengths: Sequence[str] = (), volumes: Sequence[str] = (), z_index: str | None = None, pixel: float = PIXEL_UM, section: float = SECTION_UM) -> DataFrame:
    """Micrometre columns beside pixel ones: x_px to x_um, squared for areas, times the section for volumes."""
    name = lambda c: (c[:-3] if c.endswith("_px") else c) + "_um"
    made = {name(c): F.bround(F.col(c) * F.lit(pixel), 3) for c in lengths}
    made |= {name(c) + "2": F.bround(F.col(c) * F.lit(pixel * pixel), 3) for c in areas}
    made |= {name(c) + "3": F.bround(F.col(c) * F.lit(pixel * pixel * section), 3) for c in volumes}
    if z_index:
        made["z_um"] = F.bround(F.col(z_index) * F.lit(section), 3)
    return df.withColumns(made)


def apply_codebook(df: DataFrame, rules: Sequence[tuple] = CODEBOOK, out: str = "cell_type") -> DataFrame:
    """First rule that fits names the type. A rule that names a column ``df`` lacks is skipped."""
    label = F.lit(None).cast("string")
    for name, any_of, needs_no_ck in reversed(rules):
        if not {*any_of, *(("pos_CK",) if needs_no_ck else ())} <= set(df.columns):
            continue
        # A later operand is not looked at where an earlier one decides, so NULL flags count as negative.
        fits = F.coalesce(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in any_of]) if len(any_of) > 1 else F.col(any_of[0]), F.lit(0)) == 1
        if needs_no_ck:
            fits = fits & (F.coalesce(F.col("pos_CK"), F.lit(0)) == 0)
        label = F.when(fits, F.lit(name)).otherwise(label)
    return df.withColumn(out, F.coalesce(label, F.lit(UNKNOWN)))


def normalise_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Positivity flags as 0 or 1: missing becomes 0."""
    flags = columns or [c for c in df.columns if c.startswith("pos_")]
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int") for c in flags})


def sentinel_fill(df: DataFrame) -> DataFrame:
    """Cells without a 3-D identity get -1, 3-D cells without votes type Unknown and confidence 0."""
    fill = {"cell_id_3d": -1, "cell_type": UNKNOWN, "type_confidence": 0.0}
    return df.fillna({k: v for k, v in fill.items() if k in df.columns})


def min_area_filter(df: DataFrame, least: int = 200, area: str = "area_px") -> DataFrame:
    return df.filter(F.col(area) >= least)


def log_normalise(df: DataFrame, value: str = "value", out: str | None = None) -> DataFrame:
    return df.withColumn(out or value, F.log1p(value))


def classify_core(df: DataFrame, classes: DataFrame, core: str = "core") -> DataFrame:
    """Quality class of each core by a dimension table ``(core, quality)``; cores it lacks are Unknown."""
    return df.join(classes.select(core, "quality"), core, "left").fillna({"quality": UNKNOWN})


def call_positive(df: DataFrame, value: str = "mean", threshold: str = "threshold", out: str = "pos") -> DataFrame:
    return df.withColumn(out, (F.col(value) >= F.col(threshold)).cast("int"))


def reject_top_outliers(df: DataFrame, keys: Sequence[str], value: str = "mean", pos: str = "pos", least: int = 100, share: float = 0.999) -> DataFrame:
    """In groups of more than ``least`` rows, rows above the ``share`` percentile turn negative."""
    tops = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile(value, F.lit(share)).alias("_top"))
    top = F.when((F.col("_n") > least) & (F.col(value) > F.col("_top")), F.lit(0)).otherwise(F.col(pos))
    return df.join(tops, [*keys]).withColumn(pos, top).drop("_n", "_top")


def accept_stage(df: DataFrame, least_tissue: float = 0.05, least_signal: float = 0.01, least_gain: float = 0.05) -> DataFrame:
    """Fallback ladder over correlations where lower is better.

    An affine that is worse than no alignment is dropped. A warp is kept if there is enough tissue, its output is not blank
    and it gains enough over the baseline that is left. Adds akaze_ok, warp_ok, baseline, chosen and status. Columns:
    ncc_raw, ncc_affine, ncc_warp, tissue_frac, and optionally signal_frac and affine_found.
    """
    found = F.col("affine_found") if "affine_found" in df.columns else F.lit(True)
    signal = F.col("signal_frac") >= least_signal if "signal_frac" in df.columns else F.lit(True)
    affine = found & ~(F.col("ncc_affine") > F.col("ncc_raw"))
    base = F.when(affine, F.col("ncc_affine")).otherwise(F.col("ncc_raw"))
    gain = F.when(F.abs(base) > 1e-9, F.try_divide(base - F.col("ncc_warp"), F.abs(base))).otherwise(0.0)
    warp = (F.col("tissue_frac") >= least_tissue) & signal & (gain >= least_gain)
    return df.withColumns(
        {
            "akaze_ok": affine,
            "baseline": base,
            "warp_ok": warp,
            "chosen": F.when(warp, "warp").when(affine, "affine").otherwise("raw"),
            "status": F.when(affine | warp, "OK").otherwise("FAILED"),
        }
    )


def pct_improvement(before: Column, after: Column) -> Column:
    """Per cent by which ``after`` is lower; 0 where there is nothing to compare with."""
    return F.when(F.abs(before) > 1e-9, (before - after) / F.abs(before) * 100.0).otherwise(0.0)


def roi_filter(df: DataFrame, cx: float, cy: float, size: int, z: tuple[int, int] | None = None) -> DataFrame:
    """Rows inside a square of side ``size`` about a centre, and inside [z0, z1) if given."""
    half = size // 2
    inside = (F.col("x") >= cx - half) & (F.col("x") < cx + half) & (F.col("y") >= cy - half) & (F.col("y") < cy + half)
    if z is not None:
        inside = inside & (F.col("z") >= z[0]) & (F.col("z") < z[1])
    return df.filter(inside)


def quadrant(df: DataFrame, height: int, width: int, y: str = "y", x: str = "x") -> DataFrame:
    """Quadrant label TL, TR, BL, BR by the mid-lines, and coordinates within it."""
    top, left = F.col(y) < height // 2, F.col(x) < width // 2
    label = F.concat(F.when(top, "T").otherwise("B"), F.when(left, "L").otherwise("R"))
    return df.withColumns({"quadrant": label, "local_y": F.when(top, F.col(y)).otherwise(F.col(y) - height // 2), "local_x": F.when(left, F.col(x)).otherwise(F.col(x) - width // 2)})


def conform(df: DataFrame, height: int, width: int, h: str = "h", w: str = "w", y: str = "y", x: str = "x") -> DataFrame:
    """Centre-crop or pad planes of shape (h, w) to a canonical shape: shift coordinates, drop what falls outside."""

    def shift(size: str, to: int) -> Column:
        return F.when(F.col(size) > to, -F.floor((F.col(size) - to) / 2)).otherwise(F.floor((F.lit(to) - F.col(size)) / 2))

    moved = df.withColumns({y: F.col(y) + shift(h, height), x: F.col(x) + shift(w, width)})
    return moved.filter((F.col(y) >= 0) & (F.col(y) < height) & (F.col(x) >= 0) & (F.col(x) < width))


def stride_sample(df: DataFrame, n: int = 4, y: str = "y", x: str = "x") -> DataFrame:
    return df.filter((F.col(y) % n == 0) & (F.col(x) % n == 0))


def affine(a: Column, b: Column, tx: Column, c: Column, d: Column, ty: Column) -> Column:
    """A 2x3 transform as a struct: x' = a x + b y + tx, y' = c x + d y + ty."""
    parts = {"a": a, "b": b, "tx": tx, "c": c, "d": d, "ty": ty}
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()])


def rotation_about(degrees: Column, cx: Column, cy: Column, scale: Column | float = 1.0) -> Column:
    """Rotation about a centre, counter-clockwise on an image whose y axis points down."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    alpha, beta = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return affine(alpha, beta, (1 - alpha) * cx - beta * cy, -beta, alpha, beta * cx + (1 - alpha) * cy)


def affine_points(df: DataFrame, m: Column, x: str = "x", y: str = "y", box: tuple[float, float] | None = None) -> DataFrame:
    """Points moved by the transform in column ``m``; with ``box`` = (width, height) clamped to it."""
    nx, ny = m["a"] * F.col(x) + m["b"] * F.col(y) + m["tx"], m["c"] * F.col(x) + m["d"] * F.col(y) + m["ty"]
    if box is not None:
        nx, ny = clip(nx, 0.0, float(box[0])), clip(ny, 0.0, float(box[1]))
    return df.withColumns({"new_x": nx, "new_y": ny})


def compose_affine(first: Column, then: Column) -> Column:
    """The transform that applies ``first`` and ``then`` on top of it."""
    f, t = first, then
    return affine(
        t["a"] * f["a"] + t["b"] * f["c"],
        t["a"] * f["b"] + t["b"] * f["d"],
        t["a"] * f["tx"] + t["b"] * f["ty"] + t["tx"],
        t["c"] * f["a"] + t["d"] * f["c"],
        t["c"] * f["b"] + t["d"] * f["d"],
        t["c"] * f["tx"] + t["d"] * f["ty"] + t["ty"],
    )


def compose_all(transforms: Column) -> Column:
    """Composition of an array of transforms, the first applied first; identity for an empty one."""
    one = affine(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    return F.aggregate(transforms, one, lambda acc, m: compose_affine(acc, m))


def tile_to_full(m: Column, x0: Column, y0: Column) -> Column:
    """A transform found in a tile with origin (x0, y0), for coordinates of the whole image."""
    return affine(m["a"], m["b"], m["tx"] + (1 - m["a"]) * x0 - m["b"] * y0, m["c"], m["d"], m["ty"] - m["c"] * x0 + (1 - m["d"]) * y0)


def singular_values(m: Column) -> tuple[Column, Column]:
    """Larger and smaller singular value of the linear part, in closed form."""
    q, r = F.hypot((m["a"] + m["d"]) / 2, (m["c"] - m["b"]) / 2), F.hypot((m["a"] - m["d"]) / 2, (m["c"] + m["b"]) / 2)
    return q + r, F.abs(q - r)


def decompose_affine(df: DataFrame, m: str = "m") -> DataFrame:
    """Rotation in degrees, mean scale in per cent off 1, and shear as the singular-value ratio in per cent off 1."""
    t = F.col(m)
    high, low = singular_values(t)
    # With a positive determinant the rotation part of the polar form has this angle.
    turned = F.degrees(F.atan2(t["c"] - t["b"], t["a"] + t["d"]))
    mirrored = F.degrees(F.atan2(t["c"] + t["b"], t["a"] - t["d"]))
    rotation = F.when(t["a"] * t["d"] - t["b"] * t["c"] >= 0, turned).otherwise(mirrored)
    return df.withColumns(
        {"rotation_deg": rotation, "scale_pct": ((high + low) / 2 - 1) * 100, "shear_pct": F.when(low > 1e-6, (ratio(high, low) - 1) * 100).otherwise(0.0)}
    )


def constrain_affine(m: Column, max_scale: float = 0.08, max_shear: float = 0.15) -> Column:
    """Singular values clamped to 1 +- ``max_scale``, then their ratio to 1 + ``max_shear``; translation untouched.

    The linear part is split as s1 u1 v1' + s2 u2 v2' by its two half-angles, so no solver is needed.
    """
    e, f, g, h = (m["a"] + m["d"]) / 2, (m["a"] - m["d"]) / 2, (m["c"] + m["b"]) / 2, (m["c"] - m["b"]) / 2
    q, r = F.hypot(e, h), F.hypot(f, g)
    signed = q - r  # negative for a mirrored transform
    low = clip(F.abs(signed), 1 - max_scale, 1 + max_scale)
    high = clip(q + r, 1 - max_scale, 1 + max_scale)
    high = F.when((low > 1e-6) & (high / low > 1 + max_shear), low * (1 + max_shear)).otherwise(high)
    low = F.when(signed < 0, -low).otherwise(low)
    sum_, diff = F.atan2(h, e), F.atan2(g, f)  # angles of left + right and left - right rotation
    q2, r2 = (high + low) / 2, (high - low) / 2
    return affine(q2 * F.cos(sum_) + r2 * F.cos(diff), r2 * F.sin(diff) - q2 * F.sin(sum_), m["tx"], q2 * F.sin(sum_) + r2 * F.sin(diff), q2 * F.cos(sum_) - r2 * F.cos(diff), m["ty"])


def strict_rigid(m: Column) -> Column:
    """A similarity made rigid: the linear part divided by the length of its first column."""
    size = F.hypot(m["a"], m["c"])
    part = lambda v: F.when(size > 1e-6, F.try_divide(v, size)).otherwise(v)
    return affine(part(m["a"]), part(m["b"]), m["tx"], part(m["c"]), part(m["d"]), m["ty"])


def transform_gate(df: DataFrame, max_rotation: float = 15.0, least_inliers: int = 6, least_matches: int = 20) -> DataFrame:
    """Why a transform is rejected, or ``ok``: too few matches, too few inliers, too much rotation, in that order."""
    reason = (
        F.when(F.col("n_matches") < least_matches, "few_matches")
        .when(F.col("n_inliers") < least_inliers, "few_inliers")
        .when(F.abs("rotation_deg") > max_rotation, "rotation")
        .otherwise("ok")
    )
    return df.withColumns({"reason": reason, "accepted": reason == "ok"})


def regularise_field(df: DataFrame, mask: DataFrame | None = None, keys: Sequence[str] = ("core", "slice_id"), least: float = 0.5, cap: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """A correspondence grid made safe, and its summary per ``keys``.

    Cells of low confidence go to identity, longer displacements are cut to ``cap`` in their direction, and cells that
    ``mask(keys, y, x)`` lacks go to identity. Columns: identity_x, identity_y, map_x, map_y, confidence.
    """
    sure = F.col("confidence") >= least
    dx, dy = F.when(sure, F.col("map_x") - F.col("identity_x")).otherwise(0.0), F.when(sure, F.col("map_y") - F.col("identity_y")).otherwise(0.0)
    size = F.hypot(dx, dy)
    scale = F.when(size > cap, F.lit(cap) / (size + 1e-8)).otherwise(1.0)
    out = df.withColumns({"map_x": F.col("identity_x") + dx * scale, "map_y": F.col("identity_y") + dy * scale})
    if mask is not None:
        tissue = mask.select(*keys, "y", "x").distinct().withColumn("_tissue", F.lit(True))
        joined = out.join(tissue, [*keys, "y", "x"], "left")
        out = joined.withColumns({c: F.when(F.col("_tissue"), F.col(c)).otherwise(F.col(c.replace("map", "identity"))) for c in ("map_x", "map_y")}).drop("_tissue")
    n = F.sum(sure.cast("long"))
    summary = df.groupBy(*keys).agg(n.alias("n_confident"), (n * 100.0 / F.count("*")).alias("coverage_pct"), F.avg("confidence").alias("mean_confidence"))
    return out, summary


def display_id(df: DataFrame, cell: str = "cell_id_3d", seed: int = 0) -> DataFrame:
    """A stable colour number 1..255 of each 3-D cell."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(cell).cast("string")))
    return df.withColumn("display_id", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 255 + 1)


def blob_gate(df: DataFrame, min_area: float, max_area: float, min_circularity: float, min_solidity: float) -> DataFrame:
    """Region candidates of a size, roundness (4 pi A / P^2) and solidity."""
    round_ = ratio(F.lit(4 * 3.141592653589793) * F.col("area_px"), F.col("perimeter") * F.col("perimeter"))
    out = df.filter(F.col("perimeter") > 0).withColumn("circularity", round_)
    return out.filter(F.col("area_px").between(min_area, max_area) & (F.col("circularity") >= min_circularity) & (F.col("solidity") >= min_solidity))


def intensity_gate(df: DataFrame, bright: float, dim: float, min_circularity: float, peak: str = "peak") -> DataFrame:
    """Two gates: bright, or less bright and round."""
    return df.filter((F.col(peak) >= bright) | ((F.col(peak) >= dim) & (F.col("circularity") >= min_circularity)))


def exposure_advice(channels: DataFrame, ck: int = 6, af: int = 7) -> DataFrame:
    """Per file, whether autofluorescence may be subtracted from the tumour marker.

    Unmixed components: do not subtract. Else by the ratio of exposures: within 0.01 of 1 subtract plainly, otherwise
    scaled; exposures that are missing or no numbers give ``none``.
    """
    unmixed = F.max((F.lower("IsUnmixedComponent") == "true").cast("int"))
    at = lambda i: F.max(F.when(F.col("channel_index") == i, F.expr("try_cast(ExposureTime AS DOUBLE)")))
    grouped = channels.groupBy("file_id").agg(unmixed.alias("unmixed"), at(ck).alias("ck"), at(af).alias("af"))
    quotient = ratio(F.col("ck"), F.col("af"))
    advice = F.when(F.col("unmixed") == 1, "do_not_subtract").when(quotient.isNull(), "none").when(F.abs(quotient - 1) < 0.01, "subtract").otherwise("subtract_scaled")
    return grouped.select("file_id", quotient.alias("exposure_ratio"), advice.alias("advice"))


def qc_alerts(summary: DataFrame, max_weak: float = 0.15, max_drift: float = 15.0) -> DataFrame:
    """Warnings of a linking summary row: too many weak links, too much drift."""
    return summary.withColumns({"warn_weak": F.coalesce(F.col("weak_share") > max_weak, F.lit(False)), "warn_drift": F.coalesce(F.col("median_drift_px") > max_drift, F.lit(False))})


def unpivot_markers(df: DataFrame, ids: Sequence[str], prefix: str = "pos_", value: str = "pos", markers: Sequence[str] = MARKERS) -> DataFrame:
    """One row a marker instead of one column."""
    long = df.unpivot([*ids], [f"{prefix}{m}" for m in markers if f"{prefix}{m}" in df.columns], "marker", value)
    return long.withColumn("marker", F.expr(f"substring(marker, {len(prefix) + 1})"))


def share_of(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """A value as per cent of its group's total."""
    return df.withColumn(out, ratio(F.col(value) * 100.0, F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))))


def with_params(df: DataFrame, values: Mapping[str, float], key: str, out: str, default: float) -> DataFrame:
    """A per-key constant as a column, by a map literal: no join for a handful of settings."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return df.withColumn(out, F.coalesce(F.element_at(F.create_map(*pairs), F.col(key)), F.lit(default)))
