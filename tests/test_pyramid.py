"""Suppression by a pyramid of strongest places, and tables whose groups are replaced one by one."""

import math
import random

import pytest
from lamella.operators import keypoints as K
from lamella.sources import tables


def plain(points, c):
    out = {}
    for g, i, x, y, r in points:
        near = [(x - u) ** 2 + (y - v) ** 2 for h, _, u, v, s in points if h == g and None not in (u, v, s, x, y, r) and s * c > r]
        if near:
            out[g, i] = min(near)
    return out


def found(spark, points, c):
    df = spark.createDataFrame(points, "image_id int, kp_id long, x double, y double, response double")
    return {(r.image_id, r.kp_id): r.radius_sq for r in K.nearest_stronger(df, c, ["image_id"], "kp_id", "response").collect()}


@pytest.mark.parametrize("kind", ["random", "few levels", "clusters", "ring", "one place", "one response"])
@pytest.mark.parametrize("c", [0.9, 1.0])
def test_nearest_stronger_equals_brute_force(spark, kind, c):
    rng = random.Random(kind)
    rows = []
    for i in range(500):
        x, y, r = rng.uniform(-50, 900), rng.uniform(0, 400), rng.uniform(0, 10)
        if kind == "few levels":
            r = float(i % 3)
        if kind == "clusters":
            x, y = (1e6 if i % 2 else 0) + rng.uniform(0, 1e-3), rng.choice([5.0, 5.0 + 1e-9])
        if kind == "ring":
            a = rng.uniform(0, 2 * math.pi)
            x, y, r = (0.0, 0.0, 0.0) if i % 5 == 0 else (100 * math.cos(a), 100 * math.sin(a), 5.0)
        if kind == "one place":
            x, y = 3.0, 4.0
        if kind == "one response":
            r = 7.0
        rows.append((i % 3, i, x, y, r))
    rows += [(0, 900, 1e4, 1e4, 100.0), (5, 901, 1.0, 1.0, 1.0), (0, 902, None, 1.0, 9.0), (0, 903, 1.0, 1.0, None)]
    got = found(spark, rows, c)
    want = plain([r for r in rows if None not in r], c)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_flat_responses_and_one_strong_point_meet_few_tiles(spark, monkeypatch):
    """Every point's only stronger one lies far away: rows of all rounds together stay a small multiple of points times levels."""
    rows, kept = [], []
    keep = K.cut
    monkeypatch.setattr(K, "cut", lambda df: kept.append(keep(df)) or kept[-1])
    n = 4000
    rows = [(0, i, float(i % 63), float(i // 63), 1.0) for i in range(n)] + [(0, n, 1e5, 1e5, 2.0)]
    got = found(spark, rows, 0.9)
    assert len(got) == n and got[0, 0] == 2e10
    assert sum(df.count() for df in kept if "_least" in df.columns) <= 3 * n * 10


def test_no_points(spark):
    assert found(spark, [], 0.9) == {}


def test_other_cores_stay_when_one_is_written_again(spark, tmp_path):
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        both = spark.createDataFrame([(1, 10, [1]), (2, 20, [2]), (2, 21, [])], "core int, cell long, of array<int>")
        tables.write_table(both, path, format=kind)
        for _ in range(2):
            tables.write_table(both.filter("core = 2 AND cell = 20").withColumn("cell", both.cell + 5), path, format=kind)
        read = spark.read.option("header", True).format(kind).load(path)
        assert sorted((int(r.core), int(r.cell)) for r in read.collect()) == [(1, 10), (2, 25)]
        tables.write_table(both.filter("core = 1"), path, format=kind, replace="all")
        assert [int(r.core) for r in spark.read.option("header", True).format(kind).load(path).collect()] == [1]
    with pytest.raises(ValueError):
        tables.write_table(both, path, replace="rows")


def test_published_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.published(spark, path)
    first = spark.createDataFrame([("01", 1, "a"), ("01", 2, "b"), ("2", 3, "c"), (None, 4, "d")], "core string, cell int, kind string")
    tables.publish(first, path)
    assert sorted(map(tuple, tables.published(spark, path).select("core", "cell").collect()), key=repr) == [("01", 1), ("01", 2), ("2", 3), (None, 4)]
    again = spark.createDataFrame([("01", 7, 0.5), (None, 9, 1.5)], "core string, cell int, score double")
    for _ in range(2):
        tables.publish(again, path)
    # Half a write: rows without a line in the manifest.
    again.write.partitionBy("core").parquet(f"{path}/runs/run=lost")
    got = tables.published(spark, path)
    assert got.columns == ["core", "cell", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == [("01", 7, 0.5), ("2", 3, None), (None, 9, 1.5)]
    tables.publish(again.filter("false"), path, groups=spark.createDataFrame([("2",)], "core string"))
    assert sorted(r.cell for r in tables.published(spark, path).collect()) == [7, 9]
    assert tables.drop_replaced(spark, path) == 2
    assert sorted(r.cell for r in tables.published(spark, path).collect()) == [7, 9]


def test_replaced_runs_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for cell in range(3):
        run = tables.publish(spark.createDataFrame([(1, cell)], "core int, cell int"), path)
    files = tables.published(spark, path).inputFiles()
    plan = tables.published(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert run in plan and "PartitionFilters: [" in plan and files
    assert [r.cell for r in tables.published(spark, path).collect()] == [2]
