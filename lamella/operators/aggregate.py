"""Grouped summaries. Built-in aggregates combine before the shuffle; windows are over group results, not over cells."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.scalars import PIXEL_UM, SECTION_UM, ratio
from lamella.operators.lineage import BROADCAST_GROUPS, broadcast_if_small, cut


def label_stats(mask: DataFrame, keys: Sequence[str] = ("core", "slice_z"), label: str = "label") -> DataFrame:
    """Area and centroid of every label."""
    return mask.groupBy(*keys, label).agg(F.count("*").alias("area_px"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"))


def label_means(mask: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("core", "slice_z"), channel: Sequence[str] = (), value: str = "v") -> DataFrame:
    """Mean log1p intensity per label and channel. Negative intensities count as 0."""
    joined = mask.join(pixels.select(*keys, "y", "x", *channel, value), [*keys, "y", "x"])
    return joined.groupBy(*keys, "label", *channel).agg(F.avg(F.log1p(F.greatest(F.col(value), F.lit(0.0)))).alias("mean"))


def segmentation_stats(slices: DataFrame, labels: DataFrame, keys: Sequence[str] = ("core", "slice_z"), pixel: float = PIXEL_UM) -> DataFrame:
    """Cells per slice: count is the largest label; labels absent below it count with area 0. Slices without one are EMPTY.

    ``labels(keys, label, area_px)``. The median over present and absent labels needs no list of absent ones: with z zeros
    in front, the middle of n values is found by rank among the present.
    """
    per = labels.groupBy(*keys).agg(F.max("label").alias("n_cells"), F.sum("area_px").alias("total_area_px"), F.count("*").alias("_present"), F.sort_array(F.collect_list("area_px")).alias("_areas"))
    joined = slices.select(*keys).distinct().join(per, [*keys], "left")
    n, zeros = F.coalesce("n_cells", F.lit(0)), F.coalesce(F.col("n_cells") - F.col("_present"), F.lit(0))
    at = lambda rank: F.when(rank < zeros, F.lit(0)).otherwise(F.get("_areas", (rank - zeros).cast("int")))
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0
    total = F.coalesce("total_area_px", F.lit(0))
    return joined.select(
        *keys,
        n.cast("long").alias("n_cells"),
        F.when(n > 0, total / n).otherwise(0.0).alias("mean_area_px"),
        F.when(n > 0, median).otherwise(0.0).alias("median_area_px"),
        total.cast("long").alias("total_area_px"),
        (total * F.lit(pixel * pixel)).alias("total_area_um2"),
        F.when(n > 0, "OK").otherwise("EMPTY").alias("status"),
    )


def cell3d_features(members: DataFrame, keys: Sequence[str] = ("core",), cell: str = "cell_id_3d", min_slices: int = 1, min_area: int = 10, pixel: float = PIXEL_UM, section: float = SECTION_UM) -> DataFrame:
    """Extent, volume and area-weighted centroid of 3-D cells.

    ``members(keys, cell, z, slice_id, area_px, centroid_y, centroid_x)``. Cells that span fewer slices, or whose largest
    section is smaller than ``min_area``, are dropped.
    """
    weighted = lambda c: F.bround(F.coalesce(ratio(F.sum(F.col(c) * F.col("area_px")), F.sum("area_px")), F.lit(0.0)), 2)
    out = (
        members.groupBy(*keys, cell)
        .agg(
            F.min("z").alias("z_min"),
            F.max("z").alias("z_max"),
            (F.max("z") - F.min("z") + 1).alias("z_span_slices"),
            F.min_by("slice_id", "z").alias("slice_id_min"),
            F.max_by("slice_id", "z").alias("slice_id_max"),
            F.count("*").alias("n_2d_segments"),
            F.sum("area_px").alias("volume_px"),
            F.max("area_px").alias("_largest"),
            weighted("centroid_x").alias("centroid_x_px"),
            weighted("centroid_y").alias("centroid_y_px"),
            weighted("z").alias("centroid_z_idx"),
            F.sort_array(F.collect_set("slice_id")).alias("slice_ids"),
        )
        .filter((F.col("z_span_slices") >= min_slices) & (F.col("_largest") >= min_area))
        .drop("_largest")
    )
    um = lambda c, size: F.bround(F.col(c) * F.lit(size), 3)
    return out.withColumns(
        {
            "volume_um3": um("volume_px", pixel * pixel * section),
            "centroid_x_um": um("centroid_x_px", pixel),
            "centroid_y_um": um("centroid_y_px", pixel),
            "centroid_z_um": um("centroid_z_idx", section),
        }
    )


def consensus_type(cells: DataFrame, min_confidence: float = 0.5, keys: Sequence[str] = ("core",), cell: str = "cell_id_3d", order: Sequence[str] = ("slice_id", "cell_id")) -> DataFrame:
    """Majority type of each 3-D cell; a tie goes to the type met first; below ``min_confidence`` it is Ambiguous.

    ``n_slices_voted`` counts 2-D segments. ``composition`` maps each type to its votes.
    """
    votes = cells.filter(F.col(cell) > 0).groupBy(*keys, cell, "cell_type").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    best = F.min_by("cell_type", F.struct(-F.col("n"), F.col("_first")))
    out = votes.groupBy(*keys, cell).agg(
        best.alias("_best"),
        F.max("n").alias("_top"),
        F.sum("n").alias("n_slices_voted"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell_type", "n")))).alias("composition"),
    )
    confidence = F.col("_top") / F.col("n_slices_voted")
    return out.select(*keys, cell, F.when(confidence < min_confidence, "Ambiguous").otherwise(F.col("_best")).alias("cell_type"), F.bround(confidence, 3).alias("type_confidence"), "n_slices_voted", "composition")


def type_distribution(cells: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """Cells per type and their per cent of the group."""
    counts = cells.groupBy(*keys, "cell_type").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)), 4))


def valid_types(cells: DataFrame, min_cells: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Types with enough cells, per group or overall."""
    return cells.groupBy(*keys, "cell_type").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of 2-D points, counter-clockwise; fewer than three if they are collinear."""
    unique = np.unique(points, axis=0)
    if len(unique) < 3:
        return unique

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = chain(unique), chain(unique[::-1])
    return np.array(low[:-1] + high[:-1])


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return float("nan")
    x, y = corners[:, 0], corners[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def hull_faces(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three point numbers, outward) of the convex hull of 3-D points; none if they are coplanar.

    The hull of the points farthest out in 26 directions comes first; points within it are no corners, and only the others are
    looked at one by one.
    """
    if len(points) > 64:
        ways = np.array([w for w in product((-1.0, 0.0, 1.0), repeat=3) if any(w)])
        far = np.unique((points @ ways.T).argmax(axis=0))
        inner = _faces(points[far])
        if len(inner):
            p, q, r = (points[far][inner[:, k]] for k in range(3))
            normals = np.cross(q - p, r - p)
            normals /= np.linalg.norm(normals, axis=1)[:, None]
            apart = points @ normals.T - np.einsum("ij,ij->i", normals, p)
            left = np.union1d(far, np.flatnonzero(apart.max(axis=1) > 1e-9 * float(np.ptp(points, axis=0).max())))
            return left[_faces(points[left])]
    return _faces(points)


def _faces(points: np.ndarray) -> np.ndarray:
    n = len(points)
    if n < 4:
        return np.zeros((0, 3), dtype=int)
    size = float(np.ptp(points, axis=0).max()) or 1.0
    eps = 1e-9 * size
    a = int(points[:, 0].argmin())
    b = int(np.linalg.norm(points - points[a], axis=1).argmax())
    off_line = np.linalg.norm(np.cross(points - points[a], points[b] - points[a]), axis=1)
    c = int(off_line.argmax())
    normal = np.cross(points[b] - points[a], points[c] - points[a])
    height = (points - points[a]) @ normal
    d = int(np.abs(height).argmax())
    if off_line[c] <= eps * size or abs(height[d]) <= eps * max(float(np.linalg.norm(normal)), eps):
        return np.zeros((0, 3), dtype=int)
    centre = points[[a, b, c, d]].mean(axis=0)

    def outward(face: tuple[int, int, int]) -> tuple[int, int, int]:
        p, q, r = points[list(face)]
        return face if np.dot(np.cross(q - p, r - p), p - centre) > 0 else (face[0], face[2], face[1])

    faces = np.array([outward(f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))])
    def distances(of: np.ndarray, faces: np.ndarray) -> np.ndarray:
        p, q, r = (points[faces[:, k]] for k in range(3))
        normals = np.cross(q - p, r - p)
        normals /= np.maximum(np.linalg.norm(normals, axis=1), 1e-300)[:, None]
        return points[of] @ normals.T - np.einsum("ij,ij->i", normals, p)

    # The farthest point outside comes next, so that few points become corners only to be covered later.
    left = np.arange(n)
    apart = distances(left, faces)
    while True:
        most = apart.max(axis=1)
        out = most > eps
        if not out.any():
            return faces
        left, apart, most = left[out], apart[out], most[out]
        i = int(most.argmax())
        seen = apart[i] > eps
        edges = {(int(f[k]), int(f[(k + 1) % 3])) for f in faces[seen] for k in range(3)}
        rim = np.array([(p, q, left[i]) for p, q in edges if (q, p) not in edges])
        faces = np.vstack([faces[~seen], rim])
        apart = np.hstack([apart[:, ~seen], distances(left, rim)])
        apart[i] = -1.0


def line_ends(points: np.ndarray) -> np.ndarray:
    """Points without those between two others on a line along an axis: these are no corners of a hull."""
    for axis in range(points.shape[1]):
        rest = [c for c in range(points.shape[1]) if c != axis]
        points = points[np.lexsort([points[:, axis], *[points[:, c] for c in rest]])]
        turn = np.flatnonzero((np.diff(points[:, rest], axis=0) != 0).any(axis=1))
        points = points[np.unique(np.concatenate([[0], turn, turn + 1, [len(points) - 1]]))] if len(points) else points
    return points


def hull_volume(points: np.ndarray) -> float:
    faces = hull_faces(points)
    if not len(faces):
        return float("nan")
    p, q, r = points[faces[:, 0]], points[faces[:, 1]], points[faces[:, 2]]
    centre = points.mean(axis=0)
    return float(np.einsum("ij,ij->i", np.cross(p - centre, q - centre), r - centre).sum() / 6)


#: A task looks for corners among so many points at once.
HULL_ROWS = 200_000


def hull_measure(points: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("core",), out: str = "measure") -> DataFrame:
    """Area (two ``dims``) or volume (three) of the convex hull per group; NULL for degenerate sets.

    Every partition first keeps the corners of its own points, as the hull of all is the hull of the parts' corners. So what
    a group sends to one task is a few points from each partition, not its cells. Corners are carried from batch to batch.
    """
    dims, keys = [*dims], [*keys]
    needed = points.select(*keys, *[F.col(d).cast("double").alias(d) for d in dims]).dropna(subset=dims)

    def corners(parts: list[np.ndarray]) -> np.ndarray:
        values = np.unique(np.concatenate(parts), axis=0)
        if len(dims) == 2:
            return hull_points(values)
        values = line_ends(values)
        faces = hull_faces(values)
        return values[np.unique(faces)] if len(faces) else values

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        waiting = 0

        def rows() -> pd.DataFrame:
            found = [(key, corners(parts)) for key, parts in held.items()]
            return pd.concat([pd.DataFrame(kept, columns=dims).assign(**dict(zip(keys, key)))[[*keys, *dims]] for key, kept in found])

        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False, sort=False):
                held.setdefault(key, []).append(part[dims].to_numpy())
            waiting += len(frame)
            if waiting > HULL_ROWS and len(held) > 1000:
                yield rows()
                held.clear()
            if waiting > HULL_ROWS:
                held = {key: [corners(parts)] for key, parts in held.items()}
                waiting = 0
        if held:
            yield rows()

    def final(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = line_ends(np.unique(frame[dims].to_numpy(), axis=0))
        size = polygon_area(hull_points(values)) if len(dims) == 2 else hull_volume(values)
        return pd.DataFrame([[*key, None if np.isnan(size) else size]], columns=[*keys, out])

    kinds = ", ".join(f"{k} {needed.schema[k].dataType.simpleString()}" for k in keys)
    parts = needed.mapInPandas(partial, kinds + "".join(f", {d} double" for d in dims))
    return parts.groupBy(*keys).applyInPandas(final, f"{kinds}, {out} double")


def density_2d(cells: DataFrame, areas: DataFrame, keys: Sequence[str] = ("core",), slice_key: str = "slice_id") -> DataFrame:
    """Mean and sample deviation over slices of cells per mm2, absent types counting 0; ``areas(keys, slice, area_mm2)``."""
    types = cells.select(*keys, "cell_type").distinct()
    grid = areas.filter("area_mm2 IS NOT NULL").join(types, [*keys])
    counts = cells.groupBy(*keys, slice_key, "cell_type").agg(F.count("*").alias("n"))
    dense = grid.join(counts, [*keys, slice_key, "cell_type"], "left").withColumn("d", ratio(F.coalesce("n", F.lit(0)), F.col("area_mm2")))
    return dense.groupBy(*keys, "cell_type").agg(F.avg("d").alias("mean_density_per_mm2"), F.stddev_samp("d").alias("std_density_per_mm2"), F.countDistinct(slice_key).alias("n_slices"))


def density_3d(cells3d: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """Cells per mm3 by type; ``volumes(keys, volume_mm3)``, NULL volume giving NULL."""
    counts = cells3d.groupBy(*keys, "cell_type").agg(F.count("*").alias("n_cells"))
    return counts.join(volumes, [*keys], "left").withColumn("density_per_mm3", F.round(ratio(F.col("n_cells"), F.col("volume_mm3")), 4))


def nn_summary(distances: DataFrame, keys: Sequence[str] = ("core",), slice_key: str = "slice_id", dist: str = "dist") -> DataFrame:
    """Nearest-neighbour distances per ordered type pair: mean in each slice, then mean and sample deviation over slices."""
    pair = [*keys, "src_type", "tgt_type"]
    per = distances.groupBy(*pair, slice_key).agg(F.avg(dist).alias("m"), F.stddev_pop(dist).alias("s"), F.count(dist).alias("n"))
    return per.groupBy(*pair).agg(
        F.avg("m").alias("mean_dist_um"), F.stddev_samp("m").alias("std_across_slices"), F.avg("s").alias("mean_within_std"), F.countDistinct(slice_key).alias("n_slices"), F.sum("n").alias("n_src_cells")
    )


def rank_cores(metrics: DataFrame, weights: Mapping[str, float], core: str = "core") -> DataFrame:
    """Mean of each metric per core and the weighted score, best first; ties by core."""
    means = metrics.groupBy(core).agg(*[F.avg(m).alias(m) for m in weights])
    score = sum((F.col(m) * F.lit(float(w)) for m, w in weights.items()), F.lit(0.0))
    return means.withColumn("score", score).orderBy(F.desc("score"), core)


#: The two presets of score weights.
SCORE_WEIGHTS = {"jaccard": 0.3, "ncc": 0.3, "nmi": 0.4}
VOLUME_WEIGHTS = {"jaccard": 0.4, "ncc": 0.4, "nmi": 0.2}
HIGHER_IS_BETTER = {"ncc": True, "nmi": True, "mi": True, "ssim": True, "psnr": True, "grad_corr": True, "mse": False, "rmse": False, "jaccard": True}


def stage_summary(metrics: DataFrame, names: Sequence[str], stage: str = "stage", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs, mean and sample deviation of every metric per stage, missing values skipped, 5 decimals, one row a metric."""
    long = metrics.unpivot([*keys, stage], [*names], "metric", "value")
    return long.groupBy(*keys, stage, "metric").agg(F.count("*").alias("n_pairs"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value"), 5).alias("std"))


def stage_delta(metrics: DataFrame, names: Sequence[str], stage: str = "stage", better: Mapping[str, bool] = HIGHER_IS_BETTER) -> DataFrame:
    """Mean per stage, change from the stage before it and from the first one, and gain in per cent signed by direction."""
    means = metrics.unpivot([stage], [*names], "metric", "value").groupBy(stage, "metric").agg(F.avg("value").alias("mean"))
    order = Window.partitionBy("metric").orderBy(stage)
    sign = F.when(F.col("metric").isin([m for m in names if better.get(m, True)]), 1.0).otherwise(-1.0)
    gain = lambda ref: F.round(sign * (F.col("mean") - ref) / (F.abs(ref) + 1e-12) * 100, 2)
    before, first = F.lag("mean").over(order), F.first("mean").over(order)
    return means.select("metric", stage, F.round("mean", 5).alias("mean"), F.round(F.col("mean") - before, 5).alias("delta"), gain(before).alias("gain_pct"), gain(first).alias("gain_vs_first_pct"))


def cross_core_gain(gains: DataFrame, metric: str = "metric", value: str = "gain_pct") -> DataFrame:
    return gains.groupBy(metric).agg(F.bround(F.avg(value), 2).alias("mean_gain_pct"))


def tissue_area(pixels: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("core",), z: str = "slice_z", value: str = "v") -> DataFrame:
    """Mean over slices of the pixels above the slice's threshold; ``thresholds(keys, z, threshold)``."""
    above = F.sum((F.col(value) > F.col("threshold")).cast("long"))
    per = pixels.join(thresholds.select(*keys, z, "threshold"), [*keys, z]).groupBy(*keys, z).agg(above.alias("area"))
    return per.groupBy(*keys).agg(F.avg("area").alias("mean_area"), F.count("*").alias("n_slices"))


def area_by_quality(areas: DataFrame, quality: str = "quality", value: str = "mean_area") -> DataFrame:
    return areas.groupBy(quality).agg(F.count("*").alias("n_cores"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def first_slice_shrinkage(areas: DataFrame, keys: Sequence[str] = ("core",), order: str = "slice_id", reduced: float = 0.75) -> DataFrame:
    """Area of the first slice over the mean of the rest, per group of two slices or more, and the first normalised by the median."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = areas.withColumn("_r", rank).groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("area"))).alias("first_area"),
        F.avg(F.when(F.col("_r") > 1, F.col("area"))).alias("rest_mean"),
        F.median("area").alias("median_area"),
        F.count("*").alias("n_slices"),
    )
    out = out.filter("n_slices >= 2").withColumn("ratio", ratio(F.col("first_area"), F.col("rest_mean")))
    return out.withColumns({"reduced": F.col("ratio") < reduced, "first_norm": ratio(F.col("first_area"), F.col("median_area"))})


def shrinkage_summary(shrinkage: DataFrame) -> DataFrame:
    return shrinkage.agg(F.median("ratio").alias("median_ratio"), F.sum(F.col("reduced").cast("long")).alias("n_reduced"), F.count("*").alias("n_cores"))


def anchor_slice(areas: DataFrame, keys: Sequence[str] = ("core",), file: str = "file", least: float = 1000) -> DataFrame:
    """The smallest tissue area above ``least`` per group; ties by file name."""
    usable = areas.filter(F.col("area") > least)
    return usable.groupBy(*keys).agg(F.min_by(file, F.struct("area", file)).alias("anchor"), F.min("area").alias("area"))


def canonical_shape(shapes: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """The commonest (h, w) per group, ties to the larger plane; with how many planes have it and how many must conform."""
    counts = shapes.groupBy(*keys, "h", "w").agg(F.count("*").alias("n"))
    order = F.struct("n", F.col("h").cast("long") * F.col("w"), "h")
    out = counts.groupBy(*keys).agg(F.max_by(F.struct("h", "w"), order).alias("_s"), F.max("n").alias("n_copied"), F.sum("n").alias("n_total"))
    return out.select(*keys, F.col("_s.h").alias("h"), F.col("_s.w").alias("w"), "n_copied", (F.col("n_total") - F.col("n_copied")).alias("n_conformed"), "n_total")


def multi_slice_cells(mapping: DataFrame, keys: Sequence[str] = ("core",), cell: str = "cell_id_3d", slice_key: str = "slice_id") -> DataFrame:
    """Per slice, cells, those whose 3-D cell is seen in more than one slice, and the rest."""
    spans = mapping.groupBy(*keys, cell).agg((F.countDistinct(slice_key) > 1).alias("_multi"))
    multi = F.sum(F.col("_multi").cast("long"))
    return mapping.join(spans, [*keys, cell]).groupBy(*keys, slice_key).agg(F.count("*").alias("n_cells"), multi.alias("n_multi"), (F.count("*") - multi).alias("n_single"))


def positivity_summary(flags: DataFrame, keys: Sequence[str] = ("core", "slice_id"), pos: str = "pos") -> DataFrame:
    """Positive cells and per cent by marker; ``flags(keys, marker, pos)``."""
    return flags.groupBy(*keys, "marker").agg(F.sum(F.col(pos).cast("long")).alias("n_pos"), F.count("*").alias("n_cells"), F.round(F.avg(F.col(pos).cast("double")) * 100, 4).alias("pct_pos"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def centroid_drift_path(stats: DataFrame, keys: Sequence[str] = ("core", "label"), z: str = "slice_z") -> DataFrame:
    """Range of a label's centroid over its slices in x and y, and the length of its path in z order."""
    order = Window.partitionBy(*keys).orderBy(z)
    step = F.hypot(F.col("centroid_x") - F.lag("centroid_x").over(order), F.col("centroid_y") - F.lag("centroid_y").over(order))
    span = lambda c: F.max(c) - F.min(c)
    return stats.withColumn("_step", step).groupBy(*keys).agg(span("centroid_x").alias("range_x"), span("centroid_y").alias("range_y"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.count("*").alias("n_slices"))


def pair_heatmap(metrics: DataFrame, metric: str, core: str = "core", pair: str = "pair", indices: Sequence[int] | None = None) -> DataFrame:
    """Core by pair-index matrix; the index is the number before the dash of ``pair``, duplicates are averaged."""
    indexed = metrics.withColumn("_i", F.split(pair, "-")[0].cast("int"))
    grouped = indexed.groupBy(core)
    return (grouped.pivot("_i", [*indices]) if indices is not None else grouped.pivot("_i")).agg(F.avg(metric))


def box_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    five = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("p"), F.count(value).alias("n"))
    return five.select(*keys, "n", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))])


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal-width bins between a group's extremes (or given bounds); the last bin is closed. Empty bins are absent."""
    if low is None or high is None:
        ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        df = df.join(broadcast_if_small(cut(ends), BROADCAST_GROUPS), [*keys]) if keys else df.crossJoin(F.broadcast(ends))  # one row
    else:
        df = df.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))}).filter(F.col(value).between(low, high))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def method_grid(results: DataFrame, group: Sequence[str], method: str, value: str, higher: bool = True) -> DataFrame:
    """Results of a method sweep and which method is best in its group; failed methods stay with NULL and are never best."""
    best = (F.max_by if higher else F.min_by)(method, F.struct(value, method))
    usable = results.filter(F.col(value).isNotNull()).groupBy(*group).agg(best.alias("_best"))
    joined = results.join(usable, [*group], "left") if group else results.crossJoin(F.broadcast(usable))
    return joined.withColumn("is_best", F.coalesce(F.col(method) == F.col("_best"), F.lit(False))).drop("_best")


def radial_profile(pixels: DataFrame, centre_y: float, centre_x: float, keys: Sequence[str] = ("core", "slice_z"), value: str = "v", max_r: int | None = None) -> DataFrame:
    """Mean, population deviation, median and count of each ring of one pixel around a centre."""
    ring = F.floor(F.hypot(F.col("y") - F.lit(float(centre_y)), F.col("x") - F.lit(float(centre_x))))
    rows = pixels.withColumn("r", ring)
    rows = rows.filter(F.col("r") < max_r) if max_r is not None else rows
    return rows.groupBy(*keys, "r").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.count("*").alias("n"))


def halo_summary(profile: DataFrame, keys: Sequence[str] = ("core", "slice_z"), pixel: float = PIXEL_UM, search_um: float = 5.0, far: int = 10) -> DataFrame:
    """Core peak, the depletion minimum beyond ``search_um``, the halo maximum after it, and their ratio to the far rings."""
    start = max(1, int(search_um / pixel))
    low = profile.filter(F.col("r") >= start).groupBy(*keys).agg(F.min_by("r", F.struct("mean", "r")).alias("dip_r"), F.min("mean").alias("dip"))
    after = profile.join(low, [*keys]).filter(F.col("r") >= F.col("dip_r")).groupBy(*keys, "dip_r", "dip").agg(F.max_by("r", F.struct(F.col("mean"), -F.col("r"))).alias("halo_r"), F.max("mean").alias("halo"))
    ends = profile.groupBy(*keys).agg(F.max("r").alias("_last"))
    back = profile.join(ends, [*keys]).filter(F.col("r") > F.col("_last") - far).groupBy(*keys).agg(F.greatest(F.avg("mean"), F.lit(1.0)).alias("background"))
    core = profile.filter("r = 0").select(*keys, F.col("mean").alias("peak"))
    out = after.join(core, [*keys], "left").join(back, [*keys])
    return out.withColumns({"core_ratio": F.col("peak") / F.col("background"), "halo_ratio": F.col("halo") / F.col("background")})


def ring_members(pixels: DataFrame, centre_y: float, centre_x: float, r_in: float, r_out: float) -> DataFrame:
    dist = F.hypot(F.col("y") - F.lit(float(centre_y)), F.col("x") - F.lit(float(centre_x)))
    return pixels.filter((dist >= r_in) & (dist < r_out))


def hist_separability(a: DataFrame, b: DataFrame, value: str, edges: int = 80) -> DataFrame:
    """Overlap of two densities between the joint 0.5 and 99.5 percentiles: 0 apart, 1 alike."""
    both = a.select(value).unionByName(b.select(value))
    ends = both.agg(F.percentile(value, F.array(F.lit(0.005), F.lit(0.995))).alias("p")).select(F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    bins = edges - 1

    def density(df: DataFrame, name: str) -> DataFrame:
        inside = df.crossJoin(F.broadcast(ends)).filter(F.col(value).between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select("bin", name)  # at most 79 rows

    joined = density(a, "pa").join(density(b, "pb"), "bin", "full").fillna(0.0)
    return joined.agg(F.sum(F.least("pa", "pb")).alias("overlap"))


def composition_pct(two: DataFrame, three: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """Densities of types as per cent of their sum, in 2-D and 3-D, and the difference."""
    pct = lambda df, c, n: df.select(*keys, "cell_type", (F.col(c) * 100.0 / F.sum(c).over(Window.partitionBy(*keys))).alias(n))
    both = pct(two, "mean_density_per_mm2", "pct_2d").join(pct(three, "density_per_mm3", "pct_3d"), [*keys, "cell_type"], "full")
    return both.withColumn("delta_pct", F.col("pct_3d") - F.col("pct_2d"))


def field_magnitude(field: DataFrame, keys: Sequence[str] = ("core", "slice_id"), dx: Column | None = None, dy: Column | None = None) -> DataFrame:
    """Mean and largest displacement per slice."""
    size = F.hypot(F.col("map_x") - F.col("x") if dx is None else dx, F.col("map_y") - F.col("y") if dy is None else dy)
    return field.groupBy(*keys).agg(F.avg(size).alias("mean_disp"), F.max(size).alias("max_disp"))


def gaussian_weight(y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    part = lambda p, lo, hi: F.pow((F.col(p) - (lo + hi) / 2.0) / ((hi - lo) / 2.5), F.lit(2.0))
    return F.exp(-0.5 * (part("y", y0, y1) + part("x", x0, x1)))


def cosine_weight(y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    part = lambda p, lo, hi: 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * (F.col(p) - lo + 0.5) / (hi - lo))
    return part("y", y0, y1) * part("x", x0, x1)


def merge_tiles(values: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("core", "slice_id"), value: str = "v", weight: str = "gaussian") -> DataFrame:
    """Overlapping tile values blended to one per pixel, weighted by the place in the tile; failed tiles (NULL) count as 0.

    ``values(keys, tile, y, x, value)``, ``tiles(keys, tile, y0, y1, x0, x1)``.
    """
    ends = [F.col(c).cast("double") for c in ("y0", "y1", "x0", "x1")]
    w = gaussian_weight(*ends) if weight == "gaussian" else cosine_weight(*ends)
    joined = values.join(tiles, [*keys, "tile"]).withColumn("_w", w)
    return joined.groupBy(*keys, "y", "x").agg((F.sum(F.col("_w") * F.coalesce(F.col(value), F.lit(0.0))) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias(value))
