"""Label masks as runs: ``(keys, y, x0, x1, label)``, pixels x0 to x1 of an image row that bear one label.

A section of 6112 x 6112 pixels is 37 million pixel rows, but about as many runs as its cells have lines of pixels. The
operators here give what their counterparts on pixel rows give; background has no runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.scalars import ratio
from lamella.operators.joins import asked_pixels

PLANE = ("core", "slice_z")
#: Pixels of a block of an image row. Runs meet in blocks, by equal numbers.
BLOCK = 64


def runs_of_rows(rows: DataFrame, keys: Sequence[str] = PLANE, labels: str = "labels") -> DataFrame:
    """Runs of masks stored as one array per image row, ``rows(keys, y, labels)``; 0 and NULL are background."""
    at = lambda i: F.get(labels, i)
    differs = lambda i, j: ~at(i).eqNullSafe(at(j))
    places = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.coalesce(at(i), F.lit(0)) != 0)
    starts, ends = F.filter(places, lambda i: differs(i, i - 1)), F.filter(places, lambda i: differs(i, i + 1))
    pairs = F.arrays_zip(starts.alias("x0"), ends.alias("x1"))
    found = rows.filter(F.size(labels) > 0).select(*keys, F.col("y").cast("long").alias("y"), F.col(labels).alias("_l"), F.explode(pairs.alias("_r")).alias("_r"))
    return found.select(*keys, "y", F.col("_r").getField("x0").cast("long").alias("x0"), F.col("_r").getField("x1").cast("long").alias("x1"), F.get("_l", F.col("_r").getField("x0")).alias("label"))


def runs_of_pixels(mask: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """Runs of ``mask(keys, y, x, label)``. Pixels of an image row follow each other in a window of that row."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    begins = F.coalesce((F.lag("x").over(line) != F.col("x") - 1) | (F.lag("label").over(line) != F.col("label")), F.lit(True))
    numbered = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "label").withColumn("_b", begins.cast("int")).withColumn("_n", F.sum("_b").over(line))
    return numbered.groupBy(*keys, "y", "label", "_n").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*keys, "y", "x0", "x1", "label")


def pixels_of_runs(runs: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """The mask's pixel rows again."""
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def rows_of_pixels(pixels: DataFrame, keys: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """``(keys, y, values)``: an array per image row from column 0 on, NULL where a pixel is absent."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col(value).alias("v"))))
    gathered = pixels.groupBy(*keys, "y").agg(sorted_.alias("_p"))
    kind = pixels.schema[value].dataType.simpleString()
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("_p", i - 1).getField("x"))
    filled = F.flatten(F.transform("_p", lambda p, i: F.concat(F.array_repeat(F.lit(None).cast(kind), p.getField("x") - before(i) - 1), F.array(p.getField("v")))))
    return gathered.select(*keys, F.col("y").cast("long").alias("y"), filled.alias("values"))


def _length() -> Column:
    return F.col("x1") - F.col("x0") + 1


def run_stats(runs: DataFrame, keys: Sequence[str] = PLANE, label: str = "label") -> DataFrame:
    """Area and centroid of every label."""
    n = _length()
    sums = runs.groupBy(*keys, label).agg(F.sum(n).alias("area_px"), F.sum(F.col("y") * n).alias("_y"), F.sum((F.col("x0") + F.col("x1")) * n).alias("_x"))
    return sums.select(*keys, label, "area_px", (F.col("_y") / F.col("area_px")).alias("centroid_y"), (F.col("_x") / 2 / F.col("area_px")).alias("centroid_x"))


def run_means(runs: DataFrame, rows: DataFrame, keys: Sequence[str] = PLANE, channel: Sequence[str] = (), values: str = "values") -> DataFrame:
    """Mean log1p intensity per label and channel, from ``rows(keys, channel, y, values)``: a run meets its image row once.

    Negative intensities count as 0; absent pixels do not count.
    """
    met = runs.join(rows.select(*keys, *channel, F.col("y").cast("long").alias("y"), F.col(values).alias("_v")), [*keys, "y"])
    part = F.filter(F.slice("_v", F.col("x0").cast("int") + 1, _length().cast("int")), lambda v: v.isNotNull())
    summed = F.aggregate(part, F.lit(0.0), lambda s, v: s + F.log1p(F.greatest(v.cast("double"), F.lit(0.0))))
    sums = met.select(*keys, "label", *channel, summed.alias("_s"), F.size(part).alias("_n")).groupBy(*keys, "label", *channel).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return sums.filter("_n > 0").select(*keys, "label", *channel, (F.col("_s") / F.col("_n")).alias("mean"))


def _blocks(runs: DataFrame, block: int) -> DataFrame:
    """A run in each block of its image row that it lies in."""
    return runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor(F.col("x1") / block))))


def run_overlaps(runs: DataFrame, min_overlap: int = 10, min_frac: float = 0.0, keys: Sequence[str] = ("core",), z: str = "slice_z", block: int = BLOCK) -> DataFrame:
    """Labels that share pixels in adjacent sections: (keys, z, label_a, label_b, n_shared, frac).

    Intervals of x meet by an equi-join on blocks; of the blocks that two runs share, the one where the shared part begins
    counts it. Shares are summed before areas are joined.
    """
    line = [*keys, "z", "y", "_block"]
    side = lambda c, up: _blocks(runs, block).select(*keys, (F.col(z) - up).alias("z"), "y", "_block", *[F.col(v).alias(f"{v}_{c}") for v in ("x0", "x1", "label")])
    first, last = F.greatest("x0_a", "x0_b"), F.least("x1_a", "x1_b")
    met = side("a", 0).join(side("b", 1), line).filter((first <= last) & (F.floor(first / block) == F.col("_block")))
    shared = met.groupBy(*keys, "z", "label_a", "label_b").agg(F.sum(last - first + 1).alias("n_shared")).filter(F.col("n_shared") >= min_overlap)
    areas = runs.groupBy(*keys, F.col(z).alias("z"), "label").agg(F.sum(_length()).alias("area"))
    for c, up in (("a", 0), ("b", 1)):
        shared = shared.join(areas.select(*keys, (F.col("z") - up).alias("z"), F.col("label").alias(f"label_{c}"), F.col("area").alias(f"area_{c}")), [*keys, "z", f"label_{c}"])
    sized = shared.withColumn("frac", ratio(F.col("n_shared"), F.least("area_a", "area_b")))
    return sized.filter(F.col("frac") >= min_frac).select(*keys, "z", "label_a", "label_b", "n_shared", "frac")


def remap_runs(runs: DataFrame, header: DataFrame, field: DataFrame, keys: Sequence[str] = ("core", "slice_id"), block: int = BLOCK) -> DataFrame:
    """Masks under the two-step nearest warp of ``remap_labels``, from runs to runs.

    Every output pixel looks for its source among the runs of one block. A mask beyond the header's shape is dropped;
    slices without a header stay as they are.
    """
    shape = runs.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x1").alias("_w"))
    fits = shape.join(header.select(*keys, "orig_h", "orig_w"), [*keys]).filter("_h < orig_h AND _w < orig_w").select(*keys)
    source = _blocks(runs.join(fits, [*keys], "left_semi"), block)
    asked = asked_pixels(header, field, keys).withColumn("_block", F.floor(F.col("x") / block))
    met = asked.join(source, [*keys, "y", "_block"]).filter("x BETWEEN x0 AND x1")
    warped = runs_of_pixels(met.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), "label"), keys)
    return warped.unionByName(runs.join(header.select(*keys), [*keys], "left_anti").select(*warped.columns))
