"""Crowded cells counted by rows of places against pairs of cells."""

import numpy as np
import pytest
from lamella.operators import places as P
from lamella.operators import spatial as S

DIMS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def crowd(spark):
    """Cells on a lattice, several at a place; some far away, some without a place."""
    rng = np.random.default_rng(7)
    rows = [(int(i % 2), int(i), "abc"[i % 7 % 3], *(float(v) for v in rng.integers(-20, 20, 2)), float(rng.integers(0, 3)) * 4.5) for i in range(1500)]
    rows += [(0, 9000, "a", 1e6, -1e6, 0.0), (1, 9001, "b", None, 0.0, 0.0), (1, 9002, "c", float("nan"), 0.0, 0.0), (0, 9003, "b", float("inf"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "core int, cell_id long, cell_type string, x double, y double, z double")


def only(monkeypatch, name):
    """The other way of counting must not be taken."""
    monkeypatch.setattr(S, name, lambda *a: pytest.fail(name))


@pytest.mark.parametrize("dims", [DIMS[:1], DIMS[:2], DIMS])
def test_rows_of_places_count_as_pairs_of_cells(spark, crowd, dims, monkeypatch):
    got = []
    for other, tiles in (("_totals_by_cells", 9), ("_totals_by_places", 0)):
        with monkeypatch.context() as m:
            only(m, other)
            m.setattr(S, "_crowded", lambda *a: tiles)  # noqa: B023
            counts, degrees = S.neighbour_totals(crowd, 5.0, dims)
            got.append((sorted(map(tuple, counts.collect())), sorted(map(tuple, degrees.filter("n > 0").collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 18


@pytest.mark.parametrize("dims", [DIMS[:1], DIMS[:2], DIMS])
def test_drawn_types_by_rows_of_places(spark, crowd, dims, monkeypatch):
    got = []
    for other, tiles in (("_drawn_by_cells", 9), ("_drawn_by_places", 0)):
        with monkeypatch.context() as m:
            only(m, other)
            m.setattr(S, "_crowded", lambda *a: tiles)  # noqa: B023
            got.append(sorted((*r[:3], *[round(v, 6) for v in r[3:]]) for r in S.permutation_null_within(crowd, 5.0, dims, 20).collect()))
    assert got[0] == got[1] and len(got[0]) == 18


def test_many_cells_at_a_place_are_not_paired(spark, monkeypatch):
    """40,000 cells on 400 places made 800 million pairs."""
    only(monkeypatch, "_meetings")
    cells = spark.range(40000).selectExpr("0 AS core", "id AS cell_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS cell_type", "id % 20 AS x", "floor(id / 20) % 20 AS y")
    row = S.neighbour_totals(cells, 3.0, ["x", "y"])[1].first()
    edges = sum((20 - abs(u)) * (20 - abs(v)) for u in range(-3, 4) for v in range(-3, 4) if u * u + v * v <= 9)
    assert row.n == edges * 100 * 100 - 40000
    scores = S.permutation_null_within(cells, 3.0, ["x", "y"], 10).collect()
    assert len(scores) == 4 and all(r.n_perm == 10 for r in scores)


def test_scattered_cells_and_repeated_ids_are_paired(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i, "ab"[i % 2], *(float(v) for v in rng.uniform(0, 50, 2))) for i in range(300)]
    schema = "core int, cell_id long, cell_type string, x double, y double"
    assert S._crowded(spark.createDataFrame(rows, schema), 5.0, DIMS[:2], ["core"], "cell_id", 0.025, 0.125, 40.0) == 0
    cells = spark.createDataFrame([(0, i, "a", float(i % 10), 0.0) for i in range(3000)], schema)
    asked = (5.0, DIMS[:2], ["core"], "cell_id", 0.025, 0.125, 40.0)
    assert S._crowded(cells, *asked) > 0 and S._crowded(cells.union(cells.limit(1)), *asked) == 0


@pytest.mark.parametrize("most", [9, 700])
def test_sums_of_any_size_are_exact(most):
    """2^16 and more neighbours of a place."""
    rng = np.random.default_rng(9)
    n = 300 * most
    x, kinds = rng.integers(0, 3, n).astype(float), rng.integers(0, 2, n)
    ones = np.bincount(kinds)
    drawn = P.Drawn(np.ones(n, dtype=bool), [x, x * 0], np.cumsum(ones), 100.0)
    assert (drawn.kind == np.uint16) == (most == 9)
    numbers = rng.permutation(n)[:, None].astype(np.uint32)
    assert drawn.pairs(numbers)[0].tolist() == [[int(ones[s]) * (int(ones[t]) - (s == t)) for t in range(2)] for s in range(2)]


def test_distances_are_rounded_in_the_tasks_as_spark_rounds(spark):
    rng = np.random.default_rng(10)
    values = [0.0, 0.5e-6, 1.5e-6, 2.5e-6, 0.1234565, 1.0000005, 49.9999995, 1e9 + 0.1234565, 1e300, 5e-324, *rng.uniform(0, 50, 500).tolist(), *(rng.integers(0, 10**7, 500) / 1e7).tolist()]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").selectExpr("v", "round(v, 6) AS r").collect()
    assert S._rounded(np.array([r.v for r in frame]), 6).tolist() == [r.r for r in frame]
    cells = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 1.0)], "core int, cell_id long, x double, y double")
    graph = S.radius_graph(cells, 2.0, ["x", "y"], digits=6)
    assert {r.dist for r in graph.collect()} == {1.414214} and "round" not in graph._jdf.queryExecution().optimizedPlan().toString()
