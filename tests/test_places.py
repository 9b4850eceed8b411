"""Searches by places against brute force over rows."""

import math
import statistics

import numpy as np
from lamella.operators import joins as J
from lamella.operators import keypoints as K
from lamella.operators import spatial as S


def test_row_tilt_counts_pairs_of_places(spark):
    """3,000 candidates at each of two places made nine million rows; one id stands at two places."""
    rows = [(0, i, 0, 0) for i in range(3000)] + [(0, i, 100, 10) for i in range(2999, 6000)] + [(1, 1, 5, 5)]
    df = J.row_tilt(spark.createDataFrame(rows, "slide int, cand_id long, cx long, cy long"))
    got = {r.slide: round(r.tilt_deg, 9) for r in df.collect()}
    same, apart = 3000 * 2999 // 2 + 3001 * 3000 // 2, 3000 * 3001 - 1
    assert same < apart and got == {0: round(math.degrees(math.atan2(10, 100)), 9), 1: 0.0}
    assert "median" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_row_tilt_median(spark):
    rng = np.random.default_rng(5)
    rows = [(0, int(rng.integers(0, 40)), int(rng.integers(0, 60)) * 10, int(rng.integers(0, 4))) for _ in range(60)]
    near = [math.degrees(math.atan2(v - y, u - x)) for _, i, x, y in rows for _, j, u, v in rows if i != j and u >= x and abs(v - y) <= u - x and math.hypot(u - x, v - y) < 300 and (u > x or i < j)]
    got = J.row_tilt(spark.createDataFrame(rows, "slide int, cand_id long, cx long, cy long")).first()
    assert abs(got.tilt_deg - statistics.median(near)) < 1e-12


def test_nearest_region(spark):
    rng = np.random.default_rng(6)
    points = [(i % 2, i, *(int(v) for v in rng.integers(-90, 5000 if i == 3 else 90, 2))) for i in range(60)]
    regions = [(0, i, *(int(v) for v in rng.integers(-30, 30, 2))) for i in range(300)]
    want = sorted((0, p, *min((abs(r - y) + abs(c - x), i) for _, i, r, c in regions)[::-1]) for k, p, y, x in points if k == 0)
    got = K.nearest_region(spark.createDataFrame(points, "k int, point_id int, y int, x int"), spark.createDataFrame(regions, "k int, region_id int, row int, col int"), ["k"])
    assert sorted(map(tuple, got.collect())) == want


def test_buckets_follow_the_crowd(spark):
    """Buckets of 50 held all 2,500 targets here; now a few."""
    cells = spark.createDataFrame([(0, i, float(i % 50), float(i // 50)) for i in range(2500)], "core int, cell_id long, x double, y double")
    assert S._width(cells, ["x", "y"], ["core"], 50.0) <= 4
    assert {r.dist for r in S.nearest_neighbour(cells, cells, ["x", "y"]).collect()} == {1.0}
