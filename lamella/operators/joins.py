"""Joins between cells, identities, slices and planes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.scalars import same


def link_2d_to_3d(cells: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("core", "slice_id"), cell: str = "cell_id") -> DataFrame:
    """Each 2-D cell with its 3-D identity, -1 where it has none."""
    known = mapping.select(*keys, F.col("cell_id_2d").alias(cell), "cell_id_3d")
    return cells.join(known, [*keys, cell], "left").fillna({"cell_id_3d": -1})


def attach_consensus(cells3d: DataFrame, votes: DataFrame, keys: Sequence[str] = ("core", "cell_id_3d")) -> DataFrame:
    """3-D cells with the type voted for; Unknown with confidence 0 where no 2-D cell voted."""
    return cells3d.join(votes, [*keys], "left").fillna({"cell_type": "Unknown", "type_confidence": 0.0})


def compare_pairs(two: DataFrame, three: DataFrame, on: Sequence[str], values: Sequence[str], complete: bool = False) -> DataFrame:
    """2-D against 3-D results: every value as _2d, _3d and their difference; with ``complete`` only pairs in both."""
    a = two.select(*on, *[F.col(v).alias(f"{v}_2d") for v in values])
    b = three.select(*on, *[F.col(v).alias(f"{v}_3d") for v in values])
    both = a.join(b, [*on], "inner" if complete else "full")
    return both.withColumns({f"{v}_delta": F.col(f"{v}_3d") - F.col(f"{v}_2d") for v in values})


def overlap_edges(mask: DataFrame, min_overlap: int = 10, min_frac: float = 0.0, keys: Sequence[str] = ("core",), z: str = "slice_z") -> DataFrame:
    """Labels that share pixels in adjacent sections: (keys, z, label_a, label_b, n_shared, frac).

    ``frac`` is the shared part of the smaller label. Background pixels are not in ``mask``, so the equi-join is on tissue.
    """
    pixel = [*keys, "y", "x"]
    upper = mask.select(*pixel, F.col(z).alias("z"), F.col("label").alias("label_a"))
    lower = mask.select(*pixel, (F.col(z) - 1).alias("z"), F.col("label").alias("label_b"))
    shared = upper.join(lower, [*pixel, "z"]).groupBy(*keys, "z", "label_a", "label_b").agg(F.count("*").alias("n_shared"))
    areas = mask.groupBy(*keys, F.col(z).alias("z"), "label").agg(F.count("*").alias("area"))
    first = areas.select(*keys, "z", F.col("label").alias("label_a"), F.col("area").alias("area_a"))
    second = areas.select(*keys, (F.col("z") - 1).alias("z"), F.col("label").alias("label_b"), F.col("area").alias("area_b"))
    sized = shared.filter(F.col("n_shared") >= min_overlap).join(first, [*keys, "z", "label_a"]).join(second, [*keys, "z", "label_b"])
    frac = F.col("n_shared") / F.least("area_a", "area_b")
    return sized.withColumn("frac", frac).filter(F.col("frac") >= min_frac).select(*keys, "z", "label_a", "label_b", "n_shared", "frac")


def map_slice_to_z(files: DataFrame, stats: DataFrame, keys: Sequence[str] = ("core",)) -> DataFrame:
    """z of each slice id: from ``stats(keys, slice_id, z)``; a single id and a single z left over are paired; else position.

    ``files`` holds (keys, slice_id, position).
    """
    known = stats.select(*keys, "slice_id", F.col("z").alias("_known"))
    free_ids = files.join(known, [*keys, "slice_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("_n"), F.min("slice_id").alias("slice_id"))
    wanted = files.select(*keys, F.col("position").alias("_z"))
    free_z = wanted.join(known.select(*keys, F.col("_known").alias("_z")), [*keys, "_z"], "left_anti").groupBy(*keys).agg(F.count("*").alias("_m"), F.min("_z").alias("_paired"))
    paired = free_ids.filter("_n = 1").join(free_z.filter("_m = 1"), [*keys]).select(*keys, "slice_id", "_paired")
    out = files.join(known, [*keys, "slice_id"], "left").join(paired, [*keys, "slice_id"], "left")
    return out.withColumn("z", F.coalesce("_known", "_paired", "position")).drop("_known", "_paired")


def attach_tre(images: DataFrame, stats: DataFrame, name: str = "file", key: str = "key", value: str = "tre_px", order: str = "position") -> DataFrame:
    """Registration error of the first key, by position, that contains an image's name; NULL if none does.

    Every key is taken apart into its substrings of the lengths that names have, a few dozen rows a key, so that "contains"
    is an equi-join and neither side needs to be small.
    """
    lengths = sorted(r[0] for r in images.filter(F.length(name) > 0).select(F.length(name)).distinct().collect())  # lengths of file names
    if not lengths:
        return images.withColumn(value, F.lit(None).cast(stats.schema[value].dataType))
    cut_at = lambda n: lambda i: F.substring(key, i, F.lit(n))
    parts = [F.when(F.length(key) >= n, F.transform(F.sequence(F.lit(1), F.length(key) - (n - 1)), cut_at(n))) for n in lengths]
    named = stats.select(F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))).alias("_part"), F.col(key).alias("_key"), F.col(value).alias("_value"), F.col(order).alias("_order"))
    asked = images.select(F.col(name).alias("_part")).distinct()
    first = named.join(asked, "_part", "left_semi").groupBy("_part").agg(F.min_by("_value", F.struct("_order", "_key")).alias(value))
    return images.join(first.withColumnRenamed("_part", name), name, "left")


def paint_labels(pixels: DataFrame, values: DataFrame, keys: Sequence[str], value: str, label: str = "label") -> DataFrame:
    """Any per-cell value on the cell's pixels; 0 where the cell has none."""
    return pixels.join(values.select(*keys, label, value), [*keys, label], "left").fillna({value: 0})


def asked_pixels(header: DataFrame, field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _y, _x, y, x): output pixels of a two-step nearest warp and the mask's pixel that each asks for."""
    det = F.col("m.a") * F.col("m.d") - F.col("m.b") * F.col("m.c")
    inverse = {"ia": F.col("m.d") / det, "ib": -F.col("m.b") / det, "ic": -F.col("m.c") / det, "id": F.col("m.a") / det}
    heads = header.withColumns(inverse).select(*keys, "ia", "ib", "ic", "id", F.col("m.tx").alias("tx"), F.col("m.ty").alias("ty"), "orig_h", "orig_w")
    ax, ay = F.rint("map_x"), F.rint("map_y")
    inside = (ax >= 0) & (ax < F.col("orig_w")) & (ay >= 0) & (ay < F.col("orig_h"))
    sx = F.rint(F.col("ia") * (ax - F.col("tx")) + F.col("ib") * (ay - F.col("ty")))
    sy = F.rint(F.col("ic") * (ax - F.col("tx")) + F.col("id") * (ay - F.col("ty")))
    return field.join(heads, [*keys]).filter(inside).select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), sy.cast("long").alias("y"), sx.cast("long").alias("x"))


def remap_labels(mask: DataFrame, header: DataFrame, field: DataFrame, keys: Sequence[str] = ("core", "slice_id")) -> DataFrame:
    """Masks under a two-step nearest warp: the dense map, then the affine; what comes from outside is background.

    ``header(keys, m, orig_h, orig_w)`` has a struct ``m`` of the forward affine, ``field(keys, y, x, map_x, map_y)`` the
    source of every output pixel in the affine image. Every output pixel computes its source, so the warp is one equi-join.
    A mask with pixels beyond the header's shape is refused by dropping the slice; slices without a header stay as they are.
    """
    asked = asked_pixels(header, field, keys)
    shape = mask.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    fits = shape.join(header.select(*keys, "orig_h", "orig_w"), [*keys]).filter("_h < orig_h AND _w < orig_w").select(*keys)
    source = mask.join(fits, [*keys], "left_semi").withColumns({"y": F.col("y").cast("long"), "x": F.col("x").cast("long")})
    warped = asked.join(source, [*keys, "y", "x"]).select(*keys, F.col("_y").cast("long").alias("y"), F.col("_x").cast("long").alias("x"), "label")
    untouched = mask.join(header.select(*keys), [*keys], "left_anti").select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "label")
    return warped.unionByName(untouched)


def sample_linear(pixels: DataFrame, points: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Values between pixels: (keys, y, x, value) for ``points(keys, y, x, sy, sx)``; what lies outside counts as 0.

    A point meets the four pixels around it, weighted by nearness, in one equi-join.
    """
    top, left = F.floor("sy").cast("long"), F.floor("sx").cast("long")
    down, right = F.col("sy") - top, F.col("sx") - left
    corner = lambda i, j: F.struct((top + i).alias("ky"), (left + j).alias("kx"), ((down if i else 1 - down) * (right if j else 1 - right)).alias("w"))
    corners = points.select(*keys, "y", "x", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).filter("c.w > 0")
    near = corners.select(*keys, "y", "x", "c.ky", "c.kx", "c.w").join(pixels.select(*keys, F.col("y").cast("long").alias("ky"), F.col("x").cast("long").alias("kx"), F.col(value).alias("_v")), [*keys, "ky", "kx"], "left")
    return near.groupBy(*keys, "y", "x").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0))).alias(value))


def warp_values(pixels: DataFrame, header: DataFrame, field: DataFrame, keys: Sequence[str] = ("core", "slice_id"), value: str = "v") -> DataFrame:
    """Probabilities under the warp of ``remap_labels``, both steps linear: the dense map, then the affine.

    Of the affine image only the pixels that the map asks for are worked out.
    """
    det = F.col("m.a") * F.col("m.d") - F.col("m.b") * F.col("m.c")
    inverse = {"ia": F.col("m.d") / det, "ib": -F.col("m.b") / det, "ic": -F.col("m.c") / det, "id": F.col("m.a") / det}
    heads = header.withColumns(inverse).select(*keys, "ia", "ib", "ic", "id", F.col("m.tx").alias("tx"), F.col("m.ty").alias("ty"), "orig_h", "orig_w")
    asked = field.select(*keys, "y", "x", F.col("map_y").alias("sy"), F.col("map_x").alias("sx"))
    around = F.array(*[F.struct((F.floor("sy").cast("long") + i).alias("y"), (F.floor("sx").cast("long") + j).alias("x")) for i in (0, 1) for j in (0, 1)])
    needed = asked.select(*keys, F.explode(around).alias("k")).select(*keys, "k.y", "k.x").distinct().join(heads, [*keys]).filter("y >= 0 AND y < orig_h AND x >= 0 AND x < orig_w")
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    placed = needed.select(*keys, "y", "x", (F.col("ic") * dx + F.col("id") * dy).alias("sy"), (F.col("ia") * dx + F.col("ib") * dy).alias("sx"))
    return sample_linear(sample_linear(pixels, placed, keys, value), asked, keys, value)


def adjacent_pairs(pixels: DataFrame, keys: Sequence[str] = ("core",), z: str = "slice_z", value: str = "v") -> DataFrame:
    """Values ``a`` and ``b`` of the same pixel in section z and z + 1."""
    pixel = [*keys, "z", "y", "x"]
    first = pixels.select(*keys, F.col(z).alias("z"), "y", "x", F.col(value).alias("a"))
    second = pixels.select(*keys, (F.col(z) - 1).alias("z"), "y", "x", F.col(value).alias("b"))
    return first.join(second, pixel)


def next_slice(slices: DataFrame, keys: Sequence[str] = ("core",), z: str = "z") -> DataFrame:
    """A slice table's rows beside the next z of the same group, without a join."""
    return slices.withColumn("next_z", F.lead(z).over(Window.partitionBy(*keys).orderBy(z)))


def keep_slices(df: DataFrame, allowed: DataFrame, keys: Sequence[str] = ("core",), position: str = "position") -> DataFrame:
    """Rows at allowed positions; a group without an entry keeps all of its rows."""
    listed = df.join(allowed.select(*keys, position), [*keys, position], "left_semi")
    return listed.unionByName(df.join(allowed.select(*keys).distinct(), [*keys], "left_anti"))


def keep_types(df: DataFrame, types: Sequence[str], column: str = "cell_type") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def row_tilt(df: DataFrame, keys: Sequence[str] = ("slide",), reach: float = 300.0, limit: float = 12.0, item: str = "cand_id") -> DataFrame:
    """Median angle, in degrees, of pairs of neighbours in a row per group; 0 without a pair or beyond ``limit``.

    Pairs lie within ``reach``, the second to the right, no steeper than 45 degrees. Blocks of ``reach`` make the band join
    an equi-join: a partner is in the same block or in the next one. Places meet, not candidates: a pair of places counts
    as often as their candidates make pairs of different ids, and the median is read off the counts by angle.
    """
    keys = [*keys]
    each = df.groupBy(*keys, F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col(item).alias("_i")).agg(F.count("*").alias("_c")).filter("_i IS NOT NULL")
    places = each.groupBy(*keys, "_x", "_y").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"))
    block = F.floor(F.col("_x") / reach)
    dx, dy = F.col("_u") - F.col("_x"), F.col("_v") - F.col("_y")
    near = (dx > 0) & (F.abs(dy) <= F.abs(dx)) & (F.hypot(dx, dy) < reach)
    angle = F.degrees(F.atan2(dy, dx)).alias("_angle")
    left = places.select(*keys, "_x", "_y", F.col("_n").alias("_m"), F.explode(F.array(block, block + 1)).alias("_b"))
    right = places.select(*keys, F.col("_x").alias("_u"), F.col("_y").alias("_v"), "_n", block.alias("_b"))
    apart = left.join(right, [*keys, "_b"]).filter(near).select(*keys, angle, (F.col("_m") * F.col("_n")).alias("_w"))
    repeated = each.join(each.groupBy(*keys, "_i").agg(F.count("*").alias("_k")).filter("_k > 1").drop("_k"), [*keys, "_i"])
    again = repeated.join(repeated.select(*keys, "_i", F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_c").alias("_e")), [*keys, "_i"]).filter(near)
    together = places.filter("_n * _n > _sq AND _x IS NOT NULL AND _y IS NOT NULL").select(*keys, F.lit(0.0).alias("_angle"), F.expr("(_n * _n - _sq) div 2").alias("_w"))
    pairs = apart.unionByName(together).unionByName(again.select(*keys, angle, (-F.col("_c") * F.col("_e")).alias("_w")))
    counted = pairs.groupBy(*keys, "_angle").agg(F.sum("_w").alias("_w")).filter("_w > 0")
    total, upto = F.sum("_w").over(Window.partitionBy(*keys)), F.sum("_w").over(Window.partitionBy(*keys).orderBy("_angle"))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_angle")))
    middle = counted.withColumns({"_upto": upto, "_all": total}).groupBy(*keys).agg(at(F.expr("(_all - 1) div 2")).alias("_low"), at(F.expr("_all div 2")).alias("_high"))
    angles = middle.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias("_angle"))
    angle = F.coalesce("_angle", F.lit(0.0))
    out = df.select(*keys).distinct().join(angles, [*keys], "left")
    return out.select(*keys, F.when(F.abs(angle) > limit, 0.0).otherwise(angle).alias("tilt_deg"))


def _in_blocks(df: DataFrame, other: DataFrame, keys: Sequence[str], own: str, across: str, rows: int) -> DataFrame:
    """Descriptors dealt into blocks of about ``rows``, once for each block of the other side."""
    blocks = lambda x, name: x.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    mine, theirs = blocks(df, "_m"), blocks(other, "_t")
    counted = df.join(mine, [*keys]).join(theirs, [*keys]) if keys else df.crossJoin(F.broadcast(mine)).crossJoin(F.broadcast(theirs))  # one row each
    dealt = counted.withColumn(own, F.pmod(F.xxhash64("kp_id"), F.col("_m")).cast("int"))
    return dealt.filter("_t > 0").withColumn(across, F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).select(*keys, own, across, "kp_id", "d")


def match_descriptors(a: DataFrame, b: DataFrame, ratio: float = 0.80, keys: Sequence[str] = (), rows: int = 1024) -> DataFrame:
    """For each descriptor of ``a`` its nearest in ``b`` by Hamming distance on ``d``, and whether it passes the ratio test.

    Columns of both: keys (the pair of images), kp_id, d. Blocks of ``rows`` descriptors meet as arrays in one task each, and
    only the two nearest of a block go on, so that pairs are never rows and no image is gathered, however many descriptors
    it has. Of equal distances the smaller kp_id is nearer.
    """
    left, right = _in_blocks(a, b, keys, "_ab", "_bb", rows), _in_blocks(b, a, keys, "_bb", "_ab", rows)
    groups = [*keys, "_ab", "_bb"]
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"kp_id {kinds['kp_id']}, match_id {kinds['kp_id']}, dist int"

    def nearest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "kp_id", "match_id", "dist"]
        if mine.empty or theirs.empty:
            return pd.DataFrame(columns=names)
        theirs = theirs.sort_values("kp_id", ignore_index=True)
        one, two = (f["d"].to_numpy(dtype=np.int64).view(np.uint64) for f in (mine, theirs))
        code = np.bitwise_count(one[:, None] ^ two[None, :]).astype(np.int64) * len(two) + np.arange(len(two))
        best = np.partition(code, 1, axis=1)[:, :2] if len(two) > 2 else code
        at = np.repeat(np.arange(len(mine)), best.shape[1])
        out = mine.iloc[at][[*keys, "kp_id"]].reset_index(drop=True)
        return out.assign(match_id=theirs["kp_id"].to_numpy()[best.ravel() % len(two)], dist=best.ravel() // len(two))[names]

    close = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(nearest, schema)
    best = Window.partitionBy(*keys, "kp_id").orderBy("dist", "match_id")
    two = close.withColumn("_r", F.row_number().over(best)).filter("_r <= 2")
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    out = two.groupBy(*keys, "kp_id").agg(at(1, "match_id").alias("match_id"), at(1, "dist").alias("d1"), at(2, "dist").alias("d2"))
    return out.withColumn("good", F.coalesce(F.col("d1") < F.lit(ratio) * F.col("d2"), F.lit(False)))


def consecutive_links(mapping: DataFrame, edges: DataFrame, keys: Sequence[str] = ("core",), cell: str = "cell_id_3d") -> DataFrame:
    """Consecutive members of each 3-D cell, sorted by (z, label), with the pixels they share; 0 where no edge is listed.

    ``mapping(keys, cell, z, label)``, ``edges(keys, z, label_a, label_b, n_shared)``.
    """
    order = Window.partitionBy(*keys, cell).orderBy("z", "label")
    linked = mapping.select(*keys, cell, F.col("z").alias("z_a"), F.col("label").alias("label_a"), F.lead("z").over(order).alias("z_b"), F.lead("label").over(order).alias("label_b")).filter("z_b IS NOT NULL")
    known = edges.select(*keys, F.col("z").alias("z_a"), (F.col("z") + 1).alias("z_b"), "label_a", "label_b", "n_shared")
    return linked.join(known, [*keys, "z_a", "z_b", "label_a", "label_b"], "left").fillna({"n_shared": 0})
