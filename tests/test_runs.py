"""Masks as runs against masks as pixels, and plane metrics by blocks against whole planes."""

import math
import random

import numpy as np
import pytest
from lamella.operators import aggregate, imagepair, joins, runs
from lamella.operators import project as P
from pyspark.sql import functions as F


def masks(seed, shape=(3, 12, 150)):
    """Blobs of labels over block borders, single pixels, whole rows, an empty row."""
    rng = np.random.default_rng(seed)
    m = np.zeros(shape, dtype=int)
    for label in range(1, 40):
        z, y, x = (rng.integers(0, n) for n in shape)
        m[z, y : y + rng.integers(1, 6), x : x + rng.integers(1, 90)] = label
    m[0, 3], m[1, 3], m[1, 5] = 7, 9, 0
    m[-1, 2, ::2] = 50
    return m


def pixel_rows(spark, m, core=1):
    rows = [(core, int(z), int(y), int(x), int(m[z, y, x])) for z, y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "core int, slice_z int, y int, x int, label int")


def got(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_equal_pixels(spark, seed):
    m = masks(seed)
    px = pixel_rows(spark, m)
    lines = spark.createDataFrame([(1, z, y, m[z, y].tolist()) for z in range(3) for y in range(12)] + [(1, 2, 99, []), (1, 2, 98, [None, 4, 4, None])], "core int, slice_z int, y int, labels array<int>")
    own = runs.runs_of_pixels(px).cache()
    from_rows = runs.runs_of_rows(lines)
    assert got(from_rows.filter("y < 90")) == got(own)
    assert [(r.x0, r.x1, r.label) for r in from_rows.filter("y > 90").collect()] == [(1, 2, 4)]
    assert got(runs.pixels_of_runs(own)) == got(px)
    assert got(runs.run_stats(own)) == got(aggregate.label_stats(px))
    for least, frac, block in ((1, 0.0, 64), (10, 0.1, 7), (3, 0.5, 1)):
        assert got(runs.run_overlaps(own, least, frac, block=block)) == got(joins.overlap_edges(px, least, frac))
    assert own.count() < px.count() / 4


def test_runs_shuffle_fewer_rows_than_pixels(spark):
    """Wide labels: rows that meet in the join are counted."""
    m = np.repeat(np.arange(1, 9), 64)[None, None].repeat(2, 0).repeat(20, 1)
    own = runs.runs_of_pixels(pixel_rows(spark, m))
    assert runs._blocks(own, runs.BLOCK).count() == 2 * 20 * 8
    assert got(runs.run_overlaps(own, 1)) == [(1, 1.0, i, i, 64 * 20, 0) for i in range(1, 9)]


def test_means_with_absent_pixels(spark):
    rng, m = random.Random(3), masks(3)
    rows = [(1, z, y, x, c, rng.uniform(-1, 9)) for z in range(3) for y in range(11) for x in range(150) for c in ("a", "b") if rng.random() < 0.9]
    values = spark.createDataFrame(rows, "core int, slice_z int, y int, x int, channel string, v double")
    px = pixel_rows(spark, m)
    lines = runs.rows_of_pixels(values, ["core", "slice_z", "channel"])
    assert got(runs.run_means(runs.runs_of_pixels(px), lines, channel=["channel"])) == got(aggregate.label_means(px, values, channel=["channel"]))


def test_warped_runs(spark):
    m = masks(4, (2, 10, 80))
    px = pixel_rows(spark, m).withColumnRenamed("slice_z", "slice_id")
    rng = random.Random(5)
    affine = P.affine(*[F.lit(v) for v in (0.9, 0.1, 2.0, -0.1, 1.1, -1.0)])
    header = spark.createDataFrame([(1, 0, 10, 80)], "core int, slice_id int, orig_h int, orig_w int").select("core", "slice_id", affine.alias("m"), "orig_h", "orig_w")
    field = spark.createDataFrame([(1, 0, y, x, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for y in range(10) for x in range(80)], "core int, slice_id int, y int, x int, map_x double, map_y double")
    key = ("core", "slice_id")
    want = got(joins.remap_labels(px, header, field, key))
    assert got(runs.pixels_of_runs(runs.remap_runs(runs.runs_of_pixels(px, key), header, field, key, block=16), key)) == want
    small = header.withColumn("orig_w", F.lit(5))
    assert got(runs.pixels_of_runs(runs.remap_runs(runs.runs_of_pixels(px, key), small, field, key), key)) == got(joins.remap_labels(px, small, field, key))


def test_no_runs(spark):
    none = runs.runs_of_pixels(pixel_rows(spark, masks(0)).filter("false"))
    assert got(runs.run_stats(none)) == got(runs.run_overlaps(none)) == []


def plain_ssim(a, b):
    top = max(a.max(), b.max(), 1)
    a, b, out = a / top, b / top, []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
    return float(np.mean(out)) if out else None


def plain_sobel(v):
    p = np.pad(v, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.hypot(gx, gy)


def pair_rows(spark, planes):
    rows = [(k, 0, y, x, float(a[y, x]), float(b[y, x])) for k, (a, b) in planes.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "core int, z int, y int, x int, a double, b double")


@pytest.mark.parametrize("rows", [64, 5, 1])
def test_planes_by_blocks(spark, rows):
    rng = np.random.default_rng(1)
    planes = {k: (rng.uniform(0, 50, s), rng.uniform(0, 50, s)) for k, s in enumerate([(23, 11), (7, 7), (6, 30), (1, 1), (70, 9)])}
    planes[9] = (np.ones((9, 9)), rng.uniform(0, 1, (9, 9)))  # a constant side
    df = pair_rows(spark, planes)
    found = {r.core: r.ssim for r in imagepair.ssim(df, rows=rows).collect()}
    want = {k: plain_ssim(*p) for k, p in planes.items() if min(p[0].shape) >= 7}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)
    found = {r.core: r.grad_corr for r in imagepair.grad_corr(df, rows=rows).collect()}
    for k, (a, b) in planes.items():
        ga, gb = plain_sobel(a), plain_sobel(b)
        want = np.corrcoef(ga.ravel(), gb.ravel())[0, 1] if ga.std() >= 1e-6 and gb.std() >= 1e-6 else None
        assert found[k] is None if want is None else math.isclose(found[k], want, rel_tol=1e-9)


def test_windows_with_an_absent_pixel_are_left_out(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 5, (7, 20)), rng.uniform(0, 5, (7, 20))
    a[0, 19] = 9.0  # the joint maximum lies among the columns that are left
    df = pair_rows(spark, {0: (a, b)}).filter("NOT (y = 3 AND x < 2)")
    assert math.isclose(imagepair.ssim(df).first().ssim, plain_ssim(a[:, 2:], b[:, 2:]), rel_tol=1e-9)


def test_no_window_over_a_pair_of_planes(spark):
    df = pair_rows(spark, {0: (np.eye(8), np.eye(8))})
    for out in (imagepair.ssim(df), imagepair.grad_corr(df)):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
