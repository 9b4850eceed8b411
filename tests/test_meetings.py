"""Neighbours counted by blocks of cells against the same counts on a brute-force graph."""

import numpy as np
import pytest
from lamella.operators import spatial as S

DIMS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def cells(spark):
    """Two cores of crowded and sparse cells, some at one place, one without a place."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), int(i), "abc"[i % 3], *(float(v) for v in (rng.normal(0, 12, 3) if i % 4 else rng.uniform(-200, 200, 3)).round())) for i in range(400)]
    rows += [(0, 1000, "a", rows[0][3], rows[0][4], rows[0][5]), (1, 1001, "b", None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "core int, cell_id long, cell_type string, x double, y double, z double")


def near(cells, dims, radius):
    rows = [r for r in cells.collect() if r.x is not None]
    return {(a.core, a.cell_id, b.cell_id) for a in rows for b in rows if a.core == b.core and a.cell_id != b.cell_id and sum((a[d] - b[d]) ** 2 for d in dims) <= radius**2}


@pytest.mark.parametrize("dims", [DIMS[:2], DIMS])
def test_blocks_count_every_pair_once(spark, cells, dims, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "FILLED", 2)
    edges = near(cells, dims, 15)
    assert sorted((r.core, r.src, r.dst) for r in S.radius_graph(cells, 15, dims).collect()) == sorted(edges)
    graph = spark.createDataFrame(sorted(edges), "core int, src long, dst long")
    want = sorted(S.observed_interactions(cells, graph).collect())
    assert sorted(S.observed_within(cells, 15, dims).collect()) == want


def test_permutations_agree_with_those_of_a_graph(spark, cells, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    placed = cells.filter("x IS NOT NULL")
    graph = spark.createDataFrame(sorted(near(cells, DIMS, 15)), "core int, src long, dst long")
    rounded = lambda df: sorted((*r[:3], *[round(v, 6) for v in r[3:]]) for r in df.collect())
    assert rounded(S.permutation_null_within(placed, 15, DIMS, 50)) == rounded(S.permutation_null(placed, graph, 50, dims=DIMS))
    assert rounded(S.exact_interactions(placed, DIMS, 15, 1).drop("z_score")) == rounded(S.exact_null(placed, graph).drop("z_score"))


def test_permutations_and_observed_types_share_one_meeting(spark, cells, monkeypatch):
    """Pairs are met once; counts that share a number are told apart, in blocks of any size and for any number of types."""
    monkeypatch.setattr(S, "BLOCK", 16)
    met, meetings = [], S._meetings
    monkeypatch.setattr(S, "_meetings", lambda *a, **k: met.append(1) or meetings(*a, **k))
    got = {(r.core, r.src_type, r.tgt_type): r.observed for r in S.permutation_null_within(cells, 15, DIMS, 20).collect()}
    assert len(met) == 1
    types = {r.cell_id: r.cell_type for r in cells.collect()}
    sources = {(r.core, r.cell_type): r.n for r in cells.groupBy("core", "cell_type").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    pairs = [(core, types[a], types[b]) for core, a, b in near(cells, DIMS, 15)]
    assert {k: pytest.approx(pairs.count(k) / sources[k[:2]]) for k in got} == got


@pytest.mark.parametrize("rows,columns,width,dense", [(50, 60, 1, 0.5), (40, 70, 5, 0.4), (7, 3000, 5, 1.0), (30, 9000, 3, 1.0), (20, 40, 40, 0.5), (5, 6, 3, 0.0)])
def test_counts_that_share_a_number_are_exact(rows, columns, width, dense):
    rng = np.random.default_rng(5)
    nearby = (rng.random((rows, columns)) < dense).astype(np.float32)
    mine, theirs = rng.integers(0, width, (rows, 9)), rng.integers(0, width, (columns, 9))
    got = S._counted(nearby, mine, theirs, width)
    want = [[[nearby[mine[:, p] == s][:, theirs[:, p] == t].sum(dtype=np.int64) for t in range(width)] for s in range(width)] for p in range(9)]
    assert (got == np.array(want)).all()
