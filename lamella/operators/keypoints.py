"""Keypoints, landmarks, patches and grids of candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.scalars import ratio
from lamella.operators.lineage import broadcast_if_small, cut
from lamella.operators.threshold import minmax_scale


def cap_by_response(points: DataFrame, n: int = 20_000, keys: Sequence[str] = ("image_id",), item: str = "kp_id", response: str = "response") -> DataFrame:
    """The ``n`` strongest rows per image; ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(response), item)
    return points.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


#: Bits of a coordinate that a level of the pyramid adds: a tile has up to 16 children.
STEP = 2
#: Places of a finest tile, at most, unless they are too near to be told apart.
PLACES = 16
#: Tiles of a level that are broadcast; more are joined by shuffle.
BROADCAST_TILES = 50_000


def _pyramid(spots: DataFrame, frame: DataFrame, keys: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """Levels of tiles from the whole image down, and the places of the finest ones.

    A tile has its strongest place (top, tx, ty) and the box around its places; a level lists the children of each tile.
    """
    least = frame.agg(F.max("_n")).first()[0] or 1
    bits = STEP * max(1, -(-(least.bit_length() // 2) // STEP))
    while True:
        cell = lambda v, lo: F.least(F.floor((F.col(v) - F.col(lo)) / F.col("_span") * 2.0**bits), F.lit(2**bits - 1))  # noqa: B023, E731
        placed = spots.join(frame, [*keys]).select(*keys, "x", "y", "top", cell("x", "_x0").alias("i"), cell("y", "_y0").alias("j"))
        fullest = placed.groupBy(*keys, "i", "j").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if fullest <= PLACES or bits >= 30:
            break
        bits += STEP * max(1, (fullest.bit_length() - PLACES.bit_length()) // 4)
    placed = cut(placed)
    strongest = F.max_by(F.struct("tx", "ty"), F.struct("top", "tx", "ty")).alias("_s")
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    tiles = placed.select(*keys, "i", "j", "top", F.col("x").alias("tx"), F.col("y").alias("ty"), *[F.col(v[0]).alias(v) for v in ("x0", "x1", "y0", "y1")])
    levels, names = [], ("i", "j", "top", "tx", "ty", "x0", "x1", "y0", "y1")
    for level in range(bits // STEP + 1):
        up = 0 if level == 0 else STEP
        kids = [] if level == 0 else [F.collect_list(F.struct(*names)).alias("kids")]  # at most 4^STEP of them
        grown = tiles.groupBy(*keys, F.shiftright("i", up).alias("_i"), F.shiftright("j", up).alias("_j")).agg(F.max("top").alias("_top"), strongest, *box, *kids)
        tiles = cut(grown.select(*keys, F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_top").alias("top"), "_s.tx", "_s.ty", "x0", "x1", "y0", "y1", *(["kids"] if kids else [])))
        if kids:
            levels.append(tiles.select(*keys, "i", "j", "kids"))
            tiles = tiles.drop("kids")
    return [tiles, *levels[::-1]], placed.select(*keys, "i", "j", F.col("x").alias("tx"), F.col("y").alias("ty"), "top")


def nearest_stronger(points: DataFrame, c: float, keys: Sequence[str], item: str, response: str) -> DataFrame:
    """(keys, item, radius_sq): squared distance to the nearest point of the group whose response times ``c`` is larger.

    A pyramid of tiles carries each tile's strongest place and the box around its places. Points descend it together, a
    level a round: a tile whose strongest place is not stronger than the point is never entered, the distance to a strongest
    place that is bounds the point's search, and tiles whose box is no nearer are left out. So a point follows few tiles
    a level, meets no weaker points, and the work is in proportion to points times levels whatever the responses are; points
    of one place count as its strongest. Points without a stronger one, and those without a place or response, take no part.
    """
    every = cut(points.select(*keys, F.col(item), "x", "y", F.col(response).alias("_own")).filter("x IS NOT NULL AND y IS NOT NULL AND _own IS NOT NULL"))
    spots = cut(every.groupBy(*keys, "x", "y").agg(F.max("_own").alias("top")))
    span = lambda v: F.max(v) - F.min(v)
    frame = cut(spots.groupBy(*keys).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(span("x"), span("y"), F.lit(1e-300)).alias("_span"), F.count("*").alias("_n")))
    (roots, *levels), places = _pyramid(spots, frame, keys)
    apart = F.pow(F.col("tx") - F.col("x"), F.lit(2.0)) + F.pow(F.col("ty") - F.col("y"), F.lit(2.0))
    beyond = lambda v: F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0.0))
    stronger = F.col("top") * c > F.col("_own")
    bound = F.least("radius_sq", F.min(apart).over(Window.partitionBy(*keys, item)))
    state = every.join(broadcast_if_small(roots, BROADCAST_TILES), [*keys]).withColumn("radius_sq", F.lit(float("inf"))).filter(stronger)
    found = []
    for level in (*levels, places):
        state = state.withColumn("radius_sq", bound).withColumn("_least", beyond("x") * beyond("x") + beyond("y") * beyond("y"))
        state = cut(state.select(*every.columns, "i", "j", "radius_sq", "_least"))
        found.append(state.groupBy(*keys, item).agg(F.min("radius_sq").alias("radius_sq")))
        # A box's distance is rounded apart from a place's, so a tile just as far is entered.
        entered = state.filter(F.col("_least") <= F.col("radius_sq") * (1 + 1e-9)).drop("_least").join(broadcast_if_small(level, BROADCAST_TILES), [*keys, "i", "j"])
        if level is not places:
            entered = entered.drop("i", "j").withColumn("_k", F.explode("kids")).select(*every.columns, "radius_sq", "_k.*")
        state = entered.filter(stronger)
    found.append(state.groupBy(*keys, item).agg(F.min(apart).alias("radius_sq")))
    return reduce(DataFrame.unionByName, found).groupBy(*keys, item).agg(F.min("radius_sq").alias("radius_sq"))


def anms(points: DataFrame, n: int = 1000, c: float = 0.9, cap: int = 5000, keys: Sequence[str] = ("image_id",), item: str = "kp_id", response: str = "response") -> DataFrame:
    """Adaptive non-maximal suppression: the ``n`` points per image farthest from any clearly stronger one.

    Column radius_sq is the squared distance to the nearest point whose response times ``c`` exceeds the point's own; NULL,
    the largest, if there is none. Images of at most ``n`` points are untouched. ``cap`` bounds an image's points before
    they are compared with each other, as the method does.
    """
    kept = cap_by_response(points, cap, keys, item, response)
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = points.join(sizes.filter(F.col("_n") <= n).select(*keys), [*keys], "left_semi")
    large = kept.join(sizes.filter(F.col("_n") > n).select(*keys), [*keys], "left_semi")
    radii = nearest_stronger(large, c, keys, item, response)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_first("radius_sq"), F.desc(response), item)
    best = large.join(radii, [*keys, item], "left").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
    return best.unionByName(small.withColumn("radius_sq", F.lit(None).cast("double")).select(*best.columns))


def thin_landmarks(points: DataFrame, n: int, keys: Sequence[str] = ("image_id",), item: str = "kp_id", dx: str = "dx", dy: str = "dy") -> DataFrame:
    """The same suppression with the displacement's size as response and no factor."""
    sized = points.withColumn("_size", F.hypot(dx, dy))
    return anms(sized, n, 1.0, 2**31 - 1, keys, item, "_size").drop("_size")


def match_quality(matches: DataFrame, keys: Sequence[str] = ("image_id",), least: int = 4) -> DataFrame:
    """Matches, inliers, their ratio and whether there are too few; ``matches(keys, good, inlier)``."""
    good, inlier = F.sum(F.col("good").cast("long")), F.sum((F.col("good") & F.col("inlier")).cast("long"))
    out = matches.groupBy(*keys).agg(F.count("*").alias("n_points"), good.alias("n_matches"), inlier.alias("n_inliers"))
    return out.withColumns({"inlier_ratio": ratio(F.col("n_inliers"), F.col("n_matches")), "starved": F.col("n_matches") < least})


def greedy_spatial_topk(points: DataFrame, k: int, min_dist: float, score: str, keys: Sequence[str] = ("image_id",), item: str = "kp_id") -> DataFrame:
    """Per image, the best point, then the next best at least ``min_dist`` from all accepted, up to ``k``; column pick from 1.

    A round accepts every open point that has no better open point within ``min_dist``, which are just those that the picks
    one by one would come to, and drops the points too near to them. Tiles are so small that two points of a tile are too
    near, so only a tile's best can be accepted: a round is an equi-join of the points with the bests of the 25 tiles
    around them, however dense they lie. Rounds follow the longest chain of points that wait for each other and are never
    more than ``k``, as the best open point of an image is always accepted and points worse than its ``k``-th are dropped.
    Ties go to the smaller item, which is unique in its image; points without a finite score or place, an item or an image take
    no part.
    """
    if k < 1:
        return points.limit(0).withColumn("pick", F.lit(1))
    keys = [*keys]
    given = reduce(and_, [F.col(c).isNotNull() for c in (*keys, item)] + [F.abs(F.col(c).cast("double")) < float("inf") for c in ("x", "y", score)])
    usable = points.filter(given)
    order = F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))
    ranks = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    if min_dist <= 0:
        return usable.withColumn("pick", F.row_number().over(ranks)).filter(F.col("pick") <= k)
    # Half the distance: a tile's diagonal is below min_dist, and what is within min_dist lies two tiles away at most.
    tile = [F.floor(F.col(c) / F.lit(min_dist / 2)).cast("long") for c in ("x", "y")]
    placed = usable.select(F.struct(*points.columns).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), order.alias("_o"), tile[0].alias("_u"), tile[1].alias("_v"))
    group = [f"_k{i}" for i in range(len(keys))]
    near = F.hypot(F.col("_x") - F.col("_bx"), F.col("_y") - F.col("_by")) < min_dist
    steps = F.array(*[F.struct((F.col("_u") + i).alias("u"), (F.col("_v") + j).alias("v")) for i in range(-2, 3) for j in range(-2, 3)])

    def around(bests: DataFrame) -> DataFrame:
        spread = bests.select(*group, F.col("_x").alias("_bx"), F.col("_y").alias("_by"), F.col("_o").alias("_bo"), F.explode(steps).alias("_t"))
        return spread.select(*group, F.col("_t.u").alias("_u"), F.col("_t.v").alias("_v"), "_bx", "_by", "_bo")

    best_k = Window.partitionBy(*group).orderBy("_o")
    rest, chosen = cut(placed), None
    while not rest.isEmpty():
        bests = cut(rest.groupBy(*group, "_u", "_v").agg(F.min_by(F.struct("_row", "_x", "_y", "_o"), "_o").alias("_b")).select(*group, "_u", "_v", "_b.*"))
        waits = rest.join(around(bests), [*group, "_u", "_v"]).filter(near & (F.col("_o") < F.col("_bo")))
        free = cut(bests.join(waits.select(*group, F.col("_bo").alias("_o")).distinct(), [*group, "_o"], "left_anti").select(*bests.columns))
        found = free if chosen is None else chosen.unionByName(free)
        chosen = cut(found.withColumn("_r", F.row_number().over(best_k)).filter(F.col("_r") <= k).drop("_r"))
        full = chosen.groupBy(*group).agg(F.count("*").alias("_n"), F.max("_o").alias("_last")).filter(F.col("_n") == k).select(*group, "_last")
        gone = rest.join(around(free), [*group, "_u", "_v"]).filter(near).select(*group, "_o").distinct()
        open_ = rest.join(gone, [*group, "_o"], "left_anti").join(full, group, "left").filter("_last IS NULL OR _o < _last")
        rest = cut(open_.select(*rest.columns))
    if chosen is None:
        return usable.limit(0).withColumn("pick", F.lit(1))
    return chosen.select("_row.*").withColumn("pick", F.row_number().over(ranks))


def uniqueness(vectors: DataFrame, keys: Sequence[str] = ("image_id",), item: str = "kp_id", vector: str = "embedding") -> DataFrame:
    """Distance of each vector from its group's mean, scaled to 0..100 within the group."""
    long = vectors.select(*keys, item, F.posexplode(vector).alias("_i", "_v"))
    means = long.groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"))
    off = F.sqrt(F.sum((F.col("_v") - F.col("_m")) * (F.col("_v") - F.col("_m"))))
    distances = long.join(means, [*keys, "_i"]).groupBy(*keys, item).agg(off.alias("distance"))
    return minmax_scale(distances, "distance", keys, "_s").withColumn("uniqueness", F.col("_s") * 100).drop("_s")


def to_patches(pixels: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """Each pixel once for every sliding-window patch that covers it; patches are wholly inside the plane."""

    def starts(p: str, limit: int):
        low = F.greatest(F.ceil((F.col(p) - (size - 1)) / stride), F.lit(0))
        high = F.least(F.floor(F.col(p) / stride), F.lit((limit - size) // stride))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return pixels.withColumn("py", F.explode(starts("y", height))).withColumn("px", F.explode(starts("x", width)))


def patch_grid_filter(pixels: DataFrame, size: int, stride: int, height: int, width: int, keys: Sequence[str] = ("core", "slice_z"), value: str = "v", tissue: float = 0.0, share: float = 0.5, least_std: float = 10.0) -> DataFrame:
    """Patches with enough tissue (value above ``tissue``) and enough contrast."""
    per = to_patches(pixels, size, stride, height, width).groupBy(*keys, "py", "px").agg(F.avg((F.col(value) > tissue).cast("double")).alias("tissue_share"), F.stddev_pop(value).alias("std"))
    return per.filter((F.col("tissue_share") >= share) & (F.col("std") >= least_std))


def patch_heatmap(pixels: DataFrame, scores: DataFrame, size: int, stride: int, height: int, width: int, keys: Sequence[str] = ("core", "slice_z")) -> DataFrame:
    """Mean score of all scored patches over a pixel; ``scores(keys, py, px, score)``."""
    covered = to_patches(pixels.select(*keys, "y", "x"), size, stride, height, width).join(scores, [*keys, "py", "px"])
    return covered.groupBy(*keys, "y", "x").agg(F.avg("score").alias("heat"), F.count("*").alias("n_patches"))


def trajectory_steps(points: DataFrame, keys: Sequence[str] = ("core", "landmark_idx"), order: str = "slice_id", anchor: str | None = None) -> DataFrame:
    """Displacement of each landmark from slice to slice, away from the anchor in both directions where one is given."""
    line = Window.partitionBy(*keys).orderBy(order)
    back = lambda c: F.lag(c).over(line)
    if anchor is not None:
        back = lambda c: F.when(F.col(order) >= F.col(anchor), F.lag(c).over(line)).otherwise(F.lead(c).over(line))
        start = F.col(order) == F.col(anchor)
        return points.withColumns({"step_x": F.when(~start, F.col("x") - back("x")), "step_y": F.when(~start, F.col("y") - back("y"))}).withColumn("step", F.hypot("step_x", "step_y"))
    return points.withColumns({"step_x": F.col("x") - back("x"), "step_y": F.col("y") - back("y")}).withColumn("step", F.hypot("step_x", "step_y"))


def top_artifacts(blobs: DataFrame, n: int = 3, keys: Sequence[str] = ("slice_id", "channel"), item: str = "blob_id") -> DataFrame:
    """The ``n`` regions of largest area times peak per slice and channel."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("area_px") * F.col("peak")), item)
    return blobs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def nearest_region(points: DataFrame, regions: DataFrame, keys: Sequence[str], point: str = "point_id", region: str = "region_id", passed: str | None = None) -> DataFrame:
    """The region nearest to each point by rows plus columns, in the same group; ties by id.

    ``points(keys, point, y, x)``, ``regions(keys, region, row, col[, passed])``. A place counts with its first region. Points
    meet the regions in the tiles around them; a distance of at most a tile's width is final, and the others look on in
    tiles of twice the width. What is left after 30 doublings, such as points without a place, meets all regions of its group.
    """
    keys, found = [*keys], None
    flags = [passed] if passed else []
    first = regions.groupBy(*keys, "row", "col").agg(F.min(F.struct(region, *flags)).alias("_r"))
    places = cut(first.select(*keys, "row", "col", "_r.*"))
    open_ = cut(points.select(*keys, point, "y", "x").join(places.select(*keys).distinct(), [*keys], "left_semi"))
    width = 16.0
    while (shared := _crowd(places, keys, width)) > 8.0 and width > 1e-6:
        width /= 2.0 ** max(1, int(math.log2(shared / 8.0) / 2))
    off = F.abs(F.col("row") - F.col("y")) + F.abs(F.col("col") - F.col("x"))
    got = F.struct(region, *flags, off.alias("l1"))
    nearest = lambda pairs: pairs.groupBy(*keys, point, "y", "x").agg(F.min_by(got, F.struct(off, region)).alias("_b"))
    tile = lambda d, s=0: (F.floor(F.col(d) / F.lit(width)).cast("long") + s)
    for _ in range(30):
        around = F.array(*[F.struct(tile("y", i).alias("i"), tile("x", j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        placed = places.withColumn("_t", F.struct(tile("row").alias("i"), tile("col").alias("j")))
        final = cut(nearest(open_.withColumn("_t", F.explode(around)).join(placed, [*keys, "_t"])).filter(F.col("_b.l1") <= width))
        found = final if found is None else found.unionByName(final)
        open_ = cut(open_.join(final.select(*keys, point, "y", "x").distinct(), [*keys, point, "y", "x"], "left_anti"))
        if open_.isEmpty():
            break
        width *= 2
    best = found.unionByName(nearest(open_.join(places, [*keys])))
    return best.groupBy(*keys, point).agg(F.min_by("_b", F.struct("_b.l1", f"_b.{region}")).alias("_b")).select(*keys, point, "_b.*")


def _crowd(places: DataFrame, keys: Sequence[str], width: float) -> float:
    """With how many places a place shares a tile of ``width``, on average."""
    tiles = places.groupBy(*keys, F.floor(F.col("row") / width), F.floor(F.col("col") / width)).agg(F.count("*").cast("double").alias("_n"))
    return tiles.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0] or 0.0


def candidate_filter(df: DataFrame, least_area: float = 2000, aspect: tuple[float, float] = (0.3, 3.0)) -> DataFrame:
    return df.filter((F.col("area") >= least_area) & (F.col("w") / F.col("h")).between(*aspect))


def standard_box(df: DataFrame, keys: Sequence[str] = ("slide",), padding: float = 1.35, top: int = 30, item: str = "cand_id") -> DataFrame:
    """Side of the square box for a slide's cores: padded larger one of the median width and height, truncated."""
    chosen = _largest(df, keys, top, item)
    return chosen.groupBy(*keys).agg(F.floor(F.greatest(F.median("w"), F.median("h")) * F.lit(padding)).alias("box"))


def _largest(df: DataFrame, keys: Sequence[str], top: int, item: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("area"), item)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k")


def grid_layout(df: DataFrame, keys: Sequence[str] = ("slide",), top: int = 30, item: str = "cand_id", gap: float = 0.5) -> DataFrame:
    """Rows and numbers of a slide's largest candidates: a new row where y jumps by over half the median height.

    A core's number counts row by row and by cx within the row.
    """
    chosen = _largest(df, keys, top, item)
    heights = chosen.groupBy(*keys).agg(F.median("h").alias("_h"))
    down = Window.partitionBy(*keys).orderBy("cy", item)
    jump = (F.col("cy") - F.lag("cy").over(down) > F.col("_h") * gap).cast("int")
    rows = chosen.join(heights, [*keys]).withColumn("_j", F.coalesce(jump, F.lit(0)))
    rows = rows.withColumn("grid_row", F.sum("_j").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    across = Window.partitionBy(*keys, "grid_row").orderBy("cx", item)
    numbers = Window.partitionBy(*keys).orderBy("grid_row", "cx", item)
    return rows.withColumns({"grid_col": F.row_number().over(across) - 1, "core_no": F.row_number().over(numbers)}).drop("_h", "_j")


def sample_n(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = (), item: str = "cell_id") -> DataFrame:
    """A reproducible sample without replacement of ``n`` rows per group, by a digest of seed and id."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(item).cast("string")))
    if not keys:
        return df.orderBy(digest, item).limit(n)
    order = Window.partitionBy(*keys).orderBy(digest, item)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
