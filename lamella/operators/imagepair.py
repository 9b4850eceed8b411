"""Similarity of planes, from pixel pairs ``(keys, y, x, a, b)``; one row per pair of planes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lamella.operators.lineage import broadcast_if_small, cut
from lamella.operators.threshold import otsu

PAIR = ("core", "z")


def _present(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")


def _pearson(a: Column, b: Column, least: float) -> Column:
    """Correlation, NULL if either side hardly varies."""
    return F.when((F.stddev_pop(a) >= least) & (F.stddev_pop(b) >= least), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def error_metrics(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """mse, rmse, psnr and ncc in one pass."""
    a, b = F.col("a"), F.col("b")
    mse = F.avg((a - b) * (a - b))
    top = F.greatest(F.max(a), F.max(b), F.lit(1.0))
    psnr = F.when(mse < 1e-10, F.lit(float("inf"))).otherwise(20 * F.log10(top / F.sqrt(mse)))
    return _present(pairs).groupBy(*keys).agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), psnr.alias("psnr"), _pearson(a, b, 1e-6).alias("ncc"), F.count("*").alias("n_px"))


def _bins(pairs: DataFrame, bins: int, keys: Sequence[str]) -> DataFrame:
    """Joint histogram of both planes, each scaled to its own range: (keys, i, j, n)."""
    ends = pairs.groupBy(*keys).agg(F.min("a").alias("_a0"), F.max("a").alias("_a1"), F.min("b").alias("_b0"), F.max("b").alias("_b1"))

    def place(v: str, lo: str, hi: str) -> Column:
        scaled = (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins
        return F.when(F.col(hi) > F.col(lo), F.least(F.floor(scaled), F.lit(bins - 1))).otherwise(0)

    return pairs.join(ends, [*keys]).groupBy(*keys, place("a", "_a0", "_a1").alias("i"), place("b", "_b0", "_b1").alias("j")).agg(F.count("*").alias("n"))


def _information(joint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entropies and mutual information, in nats, of a joint histogram (keys, i, j, n)."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    shares = joint.select(*keys, "i", "j", (F.col("n") / total).alias("p"))
    pi, pj = F.sum("p").over(Window.partitionBy(*keys, "i")), F.sum("p").over(Window.partitionBy(*keys, "j"))
    parts = shares.withColumns({"pi": pi, "pj": pj})
    p = F.col("p")
    return parts.groupBy(*keys).agg(
        F.sum(p * F.log(p / (F.col("pi") * F.col("pj")))).alias("mi"),
        (-F.sum(p * F.log("pi"))).alias("h_a"),
        (-F.sum(p * F.log("pj"))).alias("h_b"),
        (-F.sum(p * F.log(p))).alias("h_ab"),
    )


def mutual_information(pairs: DataFrame, bins: int = 64, keys: Sequence[str] = PAIR) -> DataFrame:
    """mi by a joint histogram, and nmi = (H(A) + H(B)) / H(A, B) in 1..2, NULL for constant planes."""
    info = _information(_bins(_present(pairs), bins, keys), keys)
    return info.select(*keys, "mi", F.when(F.col("h_ab") >= 1e-9, (F.col("h_a") + F.col("h_b")) / F.col("h_ab")).alias("nmi"))


def nmi_label(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Label-based score 2 I / (H1 + H2) on raw values, 0..1; two constant planes score 1."""
    joint = _present(pairs).groupBy(*keys, F.col("a").alias("i"), F.col("b").alias("j")).agg(F.count("*").alias("n"))
    total = F.col("h_a") + F.col("h_b")
    return _information(joint, keys).select(*keys, F.when(total > 1e-12, 2 * F.col("mi") / total).otherwise(1.0).alias("nmi_label"))


#: Image rows of a block.
ROWS = 64
#: Pairs of planes whose maxima are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 100_000


def _by_blocks(pairs: DataFrame, keys: Sequence[str], halo: int, columns: str, measure: Callable[[np.ndarray, np.ndarray, slice], tuple | None], rows: int = ROWS) -> DataFrame:
    """``measure(a, b, own)`` of every block of ``rows`` image rows: (keys, columns).

    An image row is an array; the rows next to a block come along as its halo, so a block is worked on alone and one
    shuffle brings all of it. ``a`` and ``b`` are the block's rows with its halo, NaN where a pixel is absent, and ``own``
    the block's own rows among them.
    """
    lines = pairs.groupBy(*keys, F.col("y").cast("long").alias("y")).agg(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))).alias("_p"))
    lines = lines.select(*keys, "y", *[F.col("_p")[c].alias(c) for c in ("x", "a", "b")])
    near = F.sequence(F.floor((F.col("y") - halo) / rows), F.floor((F.col("y") + halo) / rows))
    out = StructType([*[pairs.schema[k] for k in keys], *StructType.fromDDL(columns)])

    def block(key: tuple, table: pa.Table) -> pa.Table:
        y, first = table.column("y").to_numpy(), key[len(keys)].as_py() * rows
        lists = {c: table.column(c).combine_chunks() for c in ("x", "a", "b")}
        x = lists["x"].flatten().to_numpy()
        at = np.repeat(y, lists["x"].value_lengths().to_numpy())
        top, left = min(first, int(y.min())), int(x.min())
        grids = []
        for c in ("a", "b"):
            grid = np.full((int(y.max()) - top + 1, int(x.max()) - left + 1), np.nan)
            grid[at - top, x - left] = lists[c].flatten().to_numpy(zero_copy_only=False)
            grids.append(grid)
        if len(grids[0]) <= first - top:  # only rows above the block
            found = None
        else:
            found = measure(*grids, slice(first - top, min(first - top + rows, len(grids[0]))))
        names = [f.name for f in out]
        return pa.Table.from_pylist([] if found is None else [dict(zip(names, (*[k.as_py() for k in key[: len(keys)]], *found)))], schema=to_arrow_schema(out))

    return lines.withColumn("_block", F.explode(near)).groupBy(*keys, "_block").applyInArrow(block, out)


def _box_means(v: np.ndarray, size: int) -> np.ndarray:
    """Means over every full window of ``size`` x ``size``, by prefix sums along the rows and then down the columns."""
    for axis in (0, 1):
        total = np.insert(np.cumsum(v, axis=axis), 0, 0, axis=axis)
        v = np.take(total, range(size, total.shape[axis]), axis=axis) - np.take(total, range(total.shape[axis] - size), axis=axis)
    return v / size**2


def ssim(pairs: DataFrame, keys: Sequence[str] = PAIR, size: int = 7, rows: int = ROWS) -> DataFrame:
    """Structural similarity after division by the joint maximum, averaged over all windows without an absent pixel.

    Blocks of image rows are worked on apart; pairs of planes too small for a window give no row.
    """
    half = size // 2
    c1, c2, unbias = 0.01**2, 0.03**2, size**2 / (size**2 - 1)

    def measure(a: np.ndarray, b: np.ndarray, own: slice) -> tuple | None:
        if min(a.shape) < size:
            return None
        absent = np.isnan(a) | np.isnan(b)
        whole = _box_means(absent.astype(float), size) == 0
        centres = np.arange(half, len(a) - half)
        whole &= ((centres >= own.start) & (centres < own.stop))[:, None]
        if not whole.any():
            return None
        a, b = np.where(absent, 0, a), np.where(absent, 0, b)
        ma, mb, aa, bb, ab = (_box_means(v, size) for v in (a, b, a * a, b * b, a * b))
        va, vb, cov = unbias * (aa - ma * ma), unbias * (bb - mb * mb), unbias * (ab - ma * mb)
        value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
        return int(whole.sum()), float(value[whole].sum())

    tops = cut(pairs.groupBy(*keys).agg(F.greatest(F.max("a"), F.max("b"), F.lit(1.0)).alias("_top")))
    scaled = pairs.join(broadcast_if_small(tops, BROADCAST_PAIRS), [*keys]).select(*keys, "y", "x", *[(F.col(v) / F.col("_top")).alias(v) for v in ("a", "b")])
    parts = _by_blocks(scaled, keys, half, "n long, total double", measure, rows)
    return parts.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("ssim"))


def _shifted(v: np.ndarray, axis: int, step: int) -> np.ndarray:
    """The neighbour a step away, and the pixel itself beyond the edge or where the neighbour is absent."""
    other = np.roll(v, -step, axis)
    np.moveaxis(other, axis, 0)[-1 if step > 0 else 0] = np.nan
    return np.where(np.isnan(other), v, other)


def sobel(v: np.ndarray) -> np.ndarray:
    """Gradient magnitude of a plane by Sobel's filter, edges replicated."""
    left, right = _shifted(v, 1, -1), _shifted(v, 1, 1)
    smooth, step = left + 2 * v + right, right - left
    down = _shifted(smooth, 0, 1) - _shifted(smooth, 0, -1)
    return np.hypot(down, _shifted(step, 0, 1) + 2 * step + _shifted(step, 0, -1))


def grad_corr(pairs: DataFrame, keys: Sequence[str] = PAIR, rows: int = ROWS) -> DataFrame:
    """Correlation of gradient magnitudes; blocks of image rows give means and centred moments, which add up exactly."""

    def measure(a: np.ndarray, b: np.ndarray, own: slice) -> tuple | None:
        ga, gb = sobel(a)[own], sobel(b)[own]
        there = ~(np.isnan(ga) | np.isnan(gb))
        if not there.any():
            return None
        ga, gb = ga[there], gb[there]
        da, db = ga - ga.mean(), gb - gb.mean()
        return len(ga), float(ga.mean()), float(gb.mean()), float(da @ da), float(db @ db), float(da @ db)

    parts = _by_blocks(pairs, keys, 1, "n long, ma double, mb double, saa double, sbb double, sab double", measure, rows)
    sums = parts.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in {"n": F.col("n"), "a": F.col("n") * F.col("ma"), "b": F.col("n") * F.col("mb"), "aa": F.col("saa") + F.col("n") * F.col("ma") ** 2, "bb": F.col("sbb") + F.col("n") * F.col("mb") ** 2, "ab": F.col("sab") + F.col("n") * F.col("ma") * F.col("mb")}.items()])
    n = F.col("n")
    va, vb = (F.greatest(F.col(s * 2) / n - F.pow(F.col(s) / n, F.lit(2.0)), F.lit(0.0)) for s in "ab")
    cov = F.col("ab") / n - F.col("a") / n * F.col("b") / n
    return sums.select(*keys, F.when((F.sqrt(va) >= 1e-6) & (F.sqrt(vb) >= 1e-6), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).alias("grad_corr"))


def _with_otsu(pairs: DataFrame, keys: Sequence[str], *sides: str) -> DataFrame:
    for side in sides:
        pairs = pairs.join(otsu(pairs, side, keys, out=f"_t{side}"), [*keys])
    return pairs


def jaccard(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Overlap of the pixels above each plane's own Otsu threshold; 0 if there are none."""
    p, q = F.col("a") > F.col("_ta"), F.col("b") > F.col("_tb")
    union = F.sum((p | q).cast("long"))
    return _with_otsu(_present(pairs), keys, "a", "b").groupBy(*keys).agg(F.when(union > 0, F.sum((p & q).cast("long")) / union).otherwise(0.0).alias("jaccard"))


def masked_rmse_ncc(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """rmse and ncc where the first plane is above its Otsu threshold. NULL for an empty first plane or fewer than two such
    pixels; a constant side has ncc 0."""
    a, b = F.col("a"), F.col("b")
    tops = pairs.groupBy(*keys).agg(F.max("a").alias("_top"))
    inside = _with_otsu(_present(pairs), keys, "a").filter("a > _ta").groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sqrt(F.avg((a - b) * (a - b))).alias("_r"), F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias("_c")
    )
    ok = (F.col("_top") != 0) & (F.col("_n") >= 2)
    return tops.join(inside, [*keys], "left").select(*keys, F.when(ok, F.col("_r")).alias("rmse_masked"), F.when(ok, F.col("_c")).alias("ncc_masked"))


def glcm_contrast(planes: DataFrame, keys: Sequence[str], value: str = "v", levels: int = 16) -> DataFrame:
    """Mean squared step between horizontal neighbours after quantising v / max to ``levels``; 0 for an empty plane."""
    tops = planes.groupBy(*keys).agg(F.max(value).alias("_top"))
    level = F.floor(F.greatest(F.try_divide(F.col(value), F.col("_top")), F.lit(0.0)) * (levels - 1))
    quantised = planes.join(tops, [*keys]).withColumn("_q", F.when(F.col("_top") != 0, level).otherwise(0))
    step = F.lead("_q").over(Window.partitionBy(*keys, "y").orderBy("x")) - F.col("_q")
    return quantised.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.avg(F.col("_s") * F.col("_s")), F.lit(0.0)).cast("double").alias("contrast"))


def tile_ncc(pairs: DataFrame, height: int, width: int, grid: tuple[int, int] = (4, 4), keys: Sequence[str] = PAIR) -> DataFrame:
    """Correlation in each tile of a grid (NULL for blank tiles; rows and columns beyond the grid are left out): mean, least
    and population deviation over tiles, and the tiles row by row."""
    rows, cols = grid
    th, tw = height // rows, width // cols
    r, c = F.floor(F.col("y") / th), F.floor(F.col("x") / tw)
    a, b = F.col("a"), F.col("b")
    tiles = _present(pairs).filter((r < rows) & (c < cols)).groupBy(*keys, (r * cols + c).alias("tile")).agg(F.round(_pearson(a, b, 1e-3), 4).alias("ncc"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tile", "ncc"))), lambda t: t["ncc"])
    return tiles.groupBy(*keys).agg(F.round(F.avg("ncc"), 4).alias("ncc_mean"), F.min("ncc").alias("ncc_min"), F.round(F.stddev_pop("ncc"), 4).alias("ncc_std"), ordered.alias("ncc_tiles"))


def mean_pool(planes: DataFrame, keys: Sequence[str], values: Sequence[str] = ("v",), n: int = 4) -> DataFrame:
    """Block means; a block cut off by the edge is filled with zeros."""
    y, x = F.floor(F.col("y") / n).alias("y"), F.floor(F.col("x") / n).alias("x")
    return planes.groupBy(*keys, y, x).agg(*[(F.sum(v) / float(n * n)).alias(v) for v in values])


def signed_ncc_masked(pairs: DataFrame, mask: DataFrame | None = None, keys: Sequence[str] = PAIR) -> DataFrame:
    """Correlation with the sign turned, so that lower is better, over the pixels of ``mask(keys, y, x)``; 0 if undefined."""
    inside = _present(pairs) if mask is None else _present(pairs).join(mask, [*keys, "y", "x"], "left_semi")
    r = inside.groupBy(*keys).agg(_pearson(F.col("a"), F.col("b"), 1e-12).alias("_r"))
    return pairs.select(*keys).distinct().join(r, [*keys], "left").select(*keys, F.coalesce(-F.col("_r"), F.lit(0.0)).alias("signed_ncc"))


def score_pairs(pairs: DataFrame, bins: int = 64, keys: Sequence[str] = PAIR, pool: int | None = None) -> DataFrame:
    """All metrics of every pair of planes; with ``pool`` after block means. Union the outcome of several stages by name."""
    if pool:
        pairs = mean_pool(pairs, keys, ("a", "b"), pool)
    out = error_metrics(pairs, keys)
    for more in (mutual_information(pairs, bins, keys), jaccard(pairs, keys), masked_rmse_ncc(pairs, keys), ssim(pairs, keys), grad_corr(pairs, keys)):
        out = out.join(more, [*keys], "left")
    return out
