"""Behaviour that derived tables do not reach: micro tables and properties of iterative operators."""

import itertools
import math
import random

import numpy as np
import pytest
from lamella.operators import aggregate as A
from lamella.operators import graph as G
from lamella.operators import imagepair as M
from lamella.operators import joins as J
from lamella.operators import keypoints as K
from lamella.operators import project as P
from lamella.operators import spatial as S
from lamella.operators import threshold as T
from lamella.sources import catalog, landmarks, tables
from pyspark.sql import functions as F


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    nodes = list(range(200))
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(150, 190)]
    got = G.connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == union_find(nodes, edges)
    alone = G.connected_components(spark.createDataFrame([(7,)], "node long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in alone.collect()] == [(7, 7)]


def test_severing(spark):
    chain = [(i, i) for i in range(7)]
    weights = [5, 3, 3, 9, 3, 8]
    nodes = chain + [(100, 0), (101, 9), (200, 3)]
    edges = [(i, i + 1, w) for i, w in enumerate(weights)]
    got = {r.node: r.component for r in G.sever_components(spark.createDataFrame(nodes, "node long, z int"), spark.createDataFrame(edges, "a long, b long, weight long"), 5).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 100: 100, 101: 101, 200: 200}


def test_vote_ties_and_confidence(spark):
    rows = [(1, "A", 0, 1), (1, "B", 1, 2), (2, "B", 0, 1), (2, "A", 1, 2), (3, "A", 0, 1), (3, "A", 1, 2), (3, "B", 2, 3), (3, "B", 3, 4), (4, "C", 0, 1)]
    rows += [(5, t, i, i) for i, t in enumerate("ABC")] + [(-1, "A", 0, 9)]
    df = spark.createDataFrame([(0, c, t, s, i) for c, t, s, i in rows], "core int, cell_id_3d int, cell_type string, slice_id int, cell_id int")
    got = {r.cell_id_3d: (r.cell_type, r.type_confidence, r.n_slices_voted) for r in A.consensus_type(df).collect()}
    assert got == {1: ("A", 0.5, 2), 2: ("B", 0.5, 2), 3: ("A", 0.5, 4), 4: ("C", 1.0, 1), 5: ("Ambiguous", 0.333, 3)}


def test_codebook_skips_missing_columns(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, 1), (0, 0, 1)], "pos_CK int, pos_CD3 int, pos_NFP int")
    assert [r.cell_type for r in P.apply_codebook(df).collect()] == ["T_cell", "Tumour", "Unknown"]


def test_thresholds_of_small_groups(spark):
    groups = {"one": [2.0], "flat": [3.0] * 6, "spikes": [0.0] * 5 + [10.0] * 5, "three": [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(k, "CK", v) for k, vs in groups.items() for v in vs], "core string, marker string, mean double")
    otsu = {r.core: r.threshold for r in T.otsu(df, "mean", ["core"]).collect()}
    assert otsu["one"] == 2.0 and otsu["flat"] == 3.0 and 0 < otsu["spikes"] < 10
    floor = {r.core: r.floor for r in T.mad_floor(df, "mean", ["core"]).collect()}
    assert floor["one"] == 0.0 and floor["flat"] == 0.0 and floor["spikes"] == 0.0
    chosen = {r.core: (r.thresh_type, r.threshold) for r in T.choose_threshold(df, "mean", ["core", "marker"]).collect()}
    assert chosen["one"] == ("sparse", 2.0) and chosen["three"] == ("sparse", 2.0) and chosen["flat"] == ("uniform", 3.0)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(9)
    groups = {"spread": rng.lognormal(0, 3, 20000), "ties": np.repeat([1.0, 2.0, 9.0], [5000, 9000, 3]), "two": np.array([4.0, 7.0]), "one": np.array([5.0]), "spike": np.concatenate([np.zeros(9990), rng.random(60) + 5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))], "g string, v double")
    levels = [0.0, 0.01, 0.3333, 0.5, 0.9, 0.9985, 1.0]
    for accuracy in (50, 2000):
        got = {r.g: r["_p"] for r in T.percentiles(df, "v", ["g"], levels, accuracy=accuracy).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            assert got[k] == pytest.approx(list(np.quantile(vs, levels)), rel=1e-12), k


def test_mixture_finds_two_modes(spark):
    rng = np.random.default_rng(5)
    two = np.concatenate([rng.normal(1, 0.3, 600), rng.normal(4, 0.5, 400)])
    one = rng.normal(2, 1, 1000)
    df = spark.createDataFrame([("two", "CK", float(v)) for v in two] + [("one", "CK", float(v)) for v in one], "core string, marker string, mean double")
    rows = {r.core: r for r in T.gmm_cut(T.gmm_1d(df, "mean", ["core"])).collect()}
    r = rows["two"]
    assert abs(min(r.mu1, r.mu2) - 1) < 0.1 and abs(max(r.mu1, r.mu2) - 4) < 0.1 and r.bic1 - r.bic2 > 6
    at = lambda x, w, m, v: w * math.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(v)
    assert abs(at(r.cut, r.w1, r.mu1, r.v1) - at(r.cut, r.w2, r.mu2, r.v2)) < 1e-6
    chosen = {x.core: x.thresh_type for x in T.choose_threshold(df, "mean", ["core", "marker"]).collect()}
    assert chosen["two"] == "gmm_bimodal"


def test_nearest_neighbour_equals_brute_force(spark):
    rng = random.Random(1)
    cells = [(0, i, rng.choice("AB"), rng.random() * 300, rng.random() * 300) for i in range(120)] + [(0, 500, "A", 5000.0, 5000.0), (0, 501, "C", 1.0, 1.0), (0, 502, "A", 1.0, 1.0)]
    df = spark.createDataFrame(cells, "core int, cell_id long, cell_type string, x double, y double")
    got = {(r.cell_id, r.tgt_type): r.dist for r in S.type_distances(df, ["x", "y"], ["core"], 20.0).collect()}
    want = {}
    for _, i, _, x, y in cells:
        for t in "ABC":
            near = [math.hypot(x - u, y - v) for _, j, s, u, v in cells if s == t and j != i]
            if near:
                want[i, t] = min(near)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[501, "A"] == 0.0 and (501, "C") not in got


def test_hulls(spark):
    rng = np.random.default_rng(0)
    cube = [(0, *map(float, p)) for p in np.array(np.meshgrid([0, 1], [0, 2], [0, 3])).reshape(3, -1).T]
    inner = [(0, float(a), float(b) * 2, float(c) * 3) for a, b, c in rng.random((200, 3))]
    flat = [(1, float(i), float(2 * i), 0.0) for i in range(5)]
    df = spark.createDataFrame(cube + inner + flat, "core int, x double, y double, z double").repartition(6)
    assert {r.core: r.measure for r in A.hull_measure(df, ["x", "y", "z"]).collect()} == {0: pytest.approx(6.0), 1: None}
    assert {r.core: r.measure for r in A.hull_measure(df, ["x", "y"]).collect()} == {0: pytest.approx(2.0), 1: None}
    points = rng.normal(size=(300, 3))
    whole = A.hull_volume(points)
    corners = np.vstack([p[np.unique(A.hull_faces(p))] for p in np.array_split(points, 5)])
    assert whole == pytest.approx(A.hull_volume(corners)) and whole > 0


def exact_null(cells, edges):
    """Mean and deviation over all permutations of the number of ordered pairs of each two types, over a symmetric graph."""
    types = [t for _, _, t, *_ in cells]
    n, count = len(types), {t: types.count(t) for t in set(types)}
    falling = lambda *sizes: math.prod(sizes) if min(sizes) > 0 else 0
    place = {c[1]: i for i, c in enumerate(cells)}
    e = [(place[a], place[b]) for a, b in edges]
    degree = np.bincount([a for a, _ in e], minlength=n)
    m = len(e)
    same, touching = 2 * m, int((degree**2).sum()) * 4 - 4 * m  # ordered pairs of directed edges: equal or reversed, sharing one cell
    apart = m * m - same - touching
    out = {}
    for s in count:
        for d in count:
            p, q = count[s], count[d]
            if s == d:
                two = falling(p, p - 1) / falling(n, n - 1)
                three = falling(p, p - 1, p - 2) / falling(n, n - 1, n - 2)
                four = falling(p, p - 1, p - 2, p - 3) / falling(n, n - 1, n - 2, n - 3)
                second = same * two + touching * three + apart * four
            else:
                two = p * q / falling(n, n - 1)
                # Of two edges that share a cell, half the ways give it a role that both agree on.
                three = (falling(p, q, q - 1) + falling(p, p - 1, q)) / falling(n, n - 1, n - 2) / 4
                four = falling(p, p - 1, q, q - 1) / falling(n, n - 1, n - 2, n - 3)
                second = m * two + touching * three + apart * four
            mean = m * two
            out[s, d] = (mean / p, math.sqrt(max(second - mean * mean, 0)) / p)
    return out


def test_permutations_have_the_exact_mean_and_deviation(spark):
    rng = random.Random(4)
    cells = [(0, i, "A" if i < 30 else "B" if i < 70 else "C", rng.random() * 100, rng.random() * 100) for i in range(90)]
    df = spark.createDataFrame(cells, "core int, cell_id long, cell_type string, x double, y double")
    graph = S.radius_graph(df, 20, ["x", "y"])
    want = exact_null(cells, [(r.src, r.dst) for r in graph.collect()])
    null = S.permutation_null(df, graph, 1000, dims=["x", "y"])
    rows = {(r.src_type, r.tgt_type): r for r in null.collect()}
    scores = {(r.src_type, r.tgt_type): r for r in S.interaction_scores(null).collect()}
    assert rows.keys() == want.keys() and len(rows) == 9
    for pair, (mean, std) in want.items():
        assert abs(scores[pair].null_mean - mean) < 5 * std / 1000**0.5 + 1e-3, pair
        assert abs(scores[pair].null_std / std - 1) < 0.12, pair
        assert scores[pair].p_value == round((rows[pair].n_ge + 1) / 1001, 4)
    again = S.permutation_null(df.repartition(3), graph.repartition(5), 1000).collect()
    assert len(again) == 9 and all(abs(r["sum"] / 1000 - want[r.src_type, r.tgt_type][0]) < 0.5 for r in again)


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 17, 64, 1000):
        got = S.permuted(np.arange(n), n, np.arange(7), 3)
        assert all(sorted(got[:, p]) == list(range(n)) for p in range(7))
    places = S.permuted(np.arange(5), 5, np.arange(20000), 1)
    assert all(abs(np.bincount(places[i], minlength=5) / 4000 - 1).max() < 0.08 for i in range(5))
    pairs = np.bincount(places[0] * 5 + places[1], minlength=25).reshape(5, 5)
    assert np.diag(pairs).sum() == 0 and abs(pairs[~np.eye(5, dtype=bool)] / 1000 - 1).max() < 0.15


def test_nearest_in_far_clusters(spark):
    rng = random.Random(8)
    near = [(0, i, rng.random() * 30, rng.random() * 30) for i in range(150)]
    far = [(0, 1000 + i, 40000 + rng.random() * 30, 70000 + rng.random() * 30) for i in range(150)] + [(0, 2000, 40010.0, 70010.0), (0, 2001, 40010.0, 70010.0)]
    frame = lambda rows: spark.createDataFrame(rows, "core int, cell_id long, x double, y double")
    got = {r.cell_id: r.dist for r in S.nearest_neighbour(frame(near), frame(far), ["x", "y"], size=5.0).collect()}
    want = {i: min(math.hypot(x - u, y - v) for _, _, u, v in far) for _, i, x, y in near}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_planes(spark):
    rows = [("same", y, x, float(y * x), float(y * x)) for y in range(8) for x in range(8)] + [("flat", y, x, 1.0, float(x)) for y in range(8) for x in range(8)]
    pairs = spark.createDataFrame(rows, "k string, y int, x int, a double, b double")
    got = {r.k: r for r in M.score_pairs(pairs, keys=["k"]).collect()}
    assert got["same"].psnr == float("inf") and got["same"].ssim == pytest.approx(1) and got["same"].ncc == pytest.approx(1) and got["same"].jaccard == 1
    assert got["flat"].ncc is None and got["flat"].grad_corr is None


def test_affine_algebra(spark):
    rng = np.random.default_rng(2)
    mats = [rng.normal(size=(2, 3)) + np.eye(2, 3) for _ in range(30)] + [np.eye(2, 3), np.array([[1.4, 0, 3], [0, 1, 2.0]]), np.array([[-1.0, 0, 0], [0, 1, 0]])]
    df = spark.createDataFrame([(i, *map(float, m.ravel())) for i, m in enumerate(mats)], "i int, a double, b double, tx double, c double, d double, ty double")
    df = df.withColumn("m", P.affine(*[F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")]))
    out = P.decompose_affine(df.withColumn("k", P.constrain_affine(F.col("m")))).collect()
    for r in out:
        u, s, vt = np.linalg.svd(mats[r.i][:, :2])
        rot = u @ vt
        assert abs(r.rotation_deg - np.degrees(np.arctan2(rot[1, 0], rot[0, 0]))) < 1e-6 or abs(abs(r.rotation_deg) - 180) < 1e-6
        assert r.scale_pct == pytest.approx((s.mean() - 1) * 100, abs=1e-6)
        t = np.clip(s, 0.92, 1.08)
        t[0] = min(t[0], t[1] * 1.15)
        assert np.allclose(u @ np.diag(t) @ vt, [[r.k.a, r.k.b], [r.k.c, r.k.d]], atol=1e-9)


def test_greedy_spacing_and_anms(spark):
    rng = random.Random(7)
    pts = [(0, i, rng.random() * 500, rng.random() * 500, rng.random()) for i in range(150)]
    df = spark.createDataFrame(pts, "image_id int, kp_id int, x double, y double, response double")
    got = sorted(K.greedy_spatial_topk(df, 6, 150.0, "response").collect(), key=lambda r: r.pick)
    assert got[0].response == max(p[4] for p in pts)
    assert all(math.hypot(a.x - b.x, a.y - b.y) >= 150 for a in got for b in got if a.pick < b.pick)
    kept = K.anms(df, 20).collect()
    assert len(kept) == 20 and any(r.radius_sq is None for r in kept)


def one_by_one(points, k, least):
    """Greedy picks of one image, one after the other."""
    taken = []
    for p in sorted(points, key=lambda p: (-p[4], p[1])):
        if len(taken) < k and all(math.hypot(p[2] - q[2], p[3] - q[3]) >= least for q in taken):
            taken.append(p)
    return [(p[0], p[1], i + 1) for i, p in enumerate(taken)]


def test_greedy_picks_equal_picks_one_by_one(spark):
    rng = random.Random(11)
    spread = [(0, i, rng.random() * 2000, rng.random() * 2000, float(rng.randrange(40))) for i in range(1500)]
    heap = [(1, i, 5 + rng.random(), 5 + rng.random(), rng.random()) for i in range(900)] + [(1, 900 + i, 10.0 * i, 5.0, 2.0) for i in range(30)]
    line = [(2, i, 6.0 * i, -3.0 * i, 100.0 - i) for i in range(60)]
    df = spark.createDataFrame(spread + heap + line, "image_id int, kp_id int, x double, y double, response double")
    for k, least in ((1000, 10.0), (7, 150.0), (25, 0.0)):
        got = sorted((r.image_id, r.kp_id, r.pick) for r in K.greedy_spatial_topk(df, k, least, "response").collect())
        assert got == sorted(one_by_one(spread, k, least) + one_by_one(heap, k, least) + one_by_one(line, k, least))


def test_greedy_picks_of_odd_rows(spark):
    rows = [(0, 1, 1.0, 1.0, None), (0, 2, None, 1.0, 5.0), (None, 3, 1.0, 1.0, 5.0), (0, 4, float("nan"), 1.0, 9.0), (0, 5, float("inf"), 1.0, 9.0), (0, 6, 1.0, 1.0, 3.0), (0, 7, 1.0, 1.0, 3.0), (0, 8, -400.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "image_id int, kp_id int, x double, y double, response double")
    assert sorted((r.kp_id, r.pick) for r in K.greedy_spatial_topk(df, 5, 10.0, "response").collect()) == [(6, 1), (8, 2)]
    empty = K.greedy_spatial_topk(df.limit(0), 5, 10.0, "response")
    assert empty.columns == [*df.columns, "pick"] and not empty.collect()


def test_dense_ids_run_through_a_group(spark):
    rng = random.Random(3)
    rows = [(c, n, n // 3) for c in range(3) for n in range(700 if c else 2000)]
    rng.shuffle(rows)
    labels = spark.createDataFrame(rows, "core int, node long, component long").repartition(7)
    got = G.assign_cell_ids(labels).collect()
    assert len(got) == len(rows) and all(r.cell_id_3d == r.component + 1 for r in got)


def test_exact_moments_equal_all_permutations(spark):
    kinds, lines = "AABBC", [(0, 1), (1, 0), (1, 2), (3, 1), (4, 2), (2, 4), (0, 4)]
    cells = spark.createDataFrame([(0, i, k) for i, k in enumerate(kinds)] + [(1, 0, "A"), (1, 1, "B")], "core int, cell_id long, cell_type string")
    graph = spark.createDataFrame([(0, a, b) for a, b in lines], "core int, src long, dst long")
    got = {(r.core, r.src_type, r.tgt_type): r for r in S.exact_null(cells, graph).collect()}
    drawn = list(itertools.permutations(kinds))
    for s in "ABC":
        for t in "ABC":
            values = [sum(p[a] == s and p[b] == t for a, b in lines) / kinds.count(s) for p in drawn]
            assert got[0, s, t].null_mean == pytest.approx(np.mean(values)) and got[0, s, t].null_std == pytest.approx(np.std(values), abs=1e-7)
    assert len(got) == 13 and all(got[1, s, t].null_std == 0 and got[1, s, t].z_score == 0 for s in "AB" for t in "AB")


def test_drawn_scores_agree_with_exact_ones(spark):
    """The library's path from cells to scores in two and three dimensions, within four standard errors and the rounding."""
    rng = random.Random(9)
    rows = [(c, i % 3, i, rng.choice("ABCD"), rng.random() * 200, rng.random() * 200) for c in range(2) for i in range(260)]
    cells = spark.createDataFrame(rows, "core int, slice_id int, cell_id long, cell_type string, x double, y double").withColumn("z", F.col("slice_id") * 4.5)
    for dims in (["x", "y"], ["x", "y", "z"]):
        want = {(r.core, r.src_type, r.tgt_type): r for r in S.exact_interactions(cells, dims, 20.0).collect()}
        got = S.interactions(cells, dims, 20.0, 400).collect()
        assert len(got) == len(want) == 32
        for r in got:
            w = want[r.core, r.src_type, r.tgt_type]
            assert abs(r.null_mean - w.null_mean) < 4.5 * w.null_std / 20 + 1e-4 and abs(r.null_std / w.null_std - 1) < 0.2 and r.observed == w.observed


def test_mixtures_say_whether_they_converged(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("m", rng.gauss(0, 1) if i % 2 else rng.gauss(6, 1)) for i in range(400)], "marker string, v double")
    assert [r.converged for r in T.gmm_1d(df, "v", ["marker"], rounds=1).collect()] == [False]
    assert [r.converged for r in T.gmm_1d(df, "v", ["marker"]).collect()] == [True]



def test_slice_filters_and_keeping(spark):
    df = spark.createDataFrame([("a", "1-3"), ("b", "0-1, 7"), ("c", "5"), ("d", " ")], "core string, ranges string")
    got = sorted(tuple(r) for r in catalog.expand_slice_filter(df).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 7), ("c", 5)]
    rows = spark.createDataFrame([("a", 1), ("a", 9), ("z", 4)], "core string, position int")
    assert sorted(tuple(r) for r in J.keep_slices(rows, catalog.expand_slice_filter(df)).collect()) == [("a", 1), ("z", 4)]


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "core1").mkdir()
    (tmp_path / "core2").mkdir()
    (tmp_path / "core1" / "t.csv").write_text("cell_id,mean,extra\n1,2.5,x\n2,NaN,y\n")
    (tmp_path / "core2" / "t.csv").write_text("mean,cell_id\n7.0,3\n")
    one = tables.read_table(spark, str(tmp_path / "core1" / "t.csv"), "cell_id int, mean double", ["cell_id"])
    assert [tuple(r) for r in one.collect()] == [(1, 2.5), (2, None)]
    with pytest.raises(ValueError, match="absent"):
        tables.read_table(spark, str(tmp_path / "core1" / "t.csv"), "cell_id int", ["absent"])
    both = tables.read_per_core(spark, [str(tmp_path / c / "t.csv") for c in ("core1", "core2")])
    assert sorted((r.Core, r.cell_id, r.extra) for r in both.collect()) == [("core1", "1", "x"), ("core1", "2", "y"), ("core2", "3", None)]
    typed = one.withColumn("core", F.lit(4)).withColumn("ids", F.array("cell_id"))
    tables.write_table(typed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("core = 4").count() == 2
    tables.write_table(typed, str(tmp_path / "csv"), format="csv")
    assert {r.ids for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"[1]", "[2]"}


def test_landmarks_and_logs(spark, tmp_path):
    doc = '{"c1": {"f1": [[1.0, 2.0], [NaN, 3.0], [4.0, 5.0]], "f2": []}, "c2": {}}'
    df = spark.createDataFrame([(doc,)], "json string")
    assert [tuple(r) for r in landmarks.read_trajectories(df).collect()] == [("c1", "f1", 0, 1.0, 2.0), ("c1", "f1", 2, 4.0, 5.0)]
    regions = spark.createDataFrame([('{"c": {"Anchor_Index": 3, "Regions": [[1, 2, 3, 4]]}, "d": {"Anchor_Index": 1, "Regions": []}}',)], "json string")
    assert [tuple(r) for r in landmarks.read_regions(regions).collect()] == [("c", 3, 0, 1, 2, 3, 4)]
    (tmp_path / "a.log").write_text("Final 3D cell count: 5\nx\nFinal 3D cell count: 12\n")
    (tmp_path / "b.log").write_text("failed\n")
    assert sorted((r.core, r.n_cells, r.status) for r in catalog.scan_run_logs(spark, str(tmp_path)).collect()) == [("a", 12, "OK"), ("b", None, "NO_COUNT")]


def test_partition_invariance(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.choice("AB"), float(rng.randrange(50))) for i in range(300)]
    df = spark.createDataFrame(rows, "core int, cell_id int, cell_type string, mean double")
    outs = [sorted(tuple(r) for r in T.otsu(df.repartition(n), "mean", ["core"]).collect()) for n in (1, 4, 16)]
    assert outs[0] == outs[1] == outs[2]
    samples = [sorted(r.cell_id for r in K.sample_n(df.repartition(n), 5, 1, ["core"]).collect()) for n in (1, 16)]
    assert samples[0] == samples[1] and len(samples[0]) == 15


def test_limits_by_channel(spark):
    nodes = spark.createDataFrame([(i, i, "a") for i in range(7)] + [(10 + i, i, "b") for i in range(7)], "node long, z int, channel string")
    edges = spark.createDataFrame([(i, i + 1, 1 + i % 3) for i in range(6)] + [(10 + i, 11 + i, 1 + i % 3) for i in range(6)], "a long, b long, weight long")
    got = {r.node: r.component for r in G.sever_components(nodes, edges, {"a": 7, "b": 3}).collect()}
    assert {got[i] for i in range(7)} == {0}
    spans = [[i for i in range(7) if got[10 + i] == c] for c in {got[10 + i] for i in range(7)}]
    assert len(spans) > 1 and all(max(s) - min(s) < 3 for s in spans)


def test_descriptors_without_keys_and_in_small_blocks(spark):
    rng = random.Random(6)
    a = [(i, rng.getrandbits(62)) for i in range(70)]
    b = [(i, rng.choice(a)[1] ^ (1 << rng.randrange(62)) if i % 2 else rng.getrandbits(62)) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "kp_id long, d long")
    want = {}
    for i, d in a:
        near = sorted((bin(d ^ e).count("1"), j) for j, e in b)
        want[i] = (near[0][1], near[0][0], near[1][0])
    for rows in (1024, 16, 1):
        got = {r.kp_id: (r.match_id, r.d1, r.d2) for r in J.match_descriptors(frame(a), frame(b), rows=rows).collect()}
        assert got == want
    assert J.match_descriptors(frame(a), frame(b).limit(0)).count() == 0 and J.match_descriptors(frame(a).limit(0), frame(b)).count() == 0
    one = J.match_descriptors(frame(a), frame(b[:1])).collect()
    assert len(one) == 70 and all(r.d2 is None and not r.good for r in one)


def test_percentiles_of_chosen_groups(spark):
    rng = random.Random(12)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5])) for g in range(4) for _ in range(300 + g)] + [(9, None), (9, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    levels = [0.02, 0.1, 0.5, 0.98]
    every = {r.g: r["_p"] for r in T.percentiles(df, "v", ["g"], levels).collect()}
    chosen = spark.createDataFrame([(0, 3), (2, 0), (9, 2), (77, 1)], "g int, j int")
    some = {r.g: r["_p"] for r in T.percentiles(df, "v", ["g"], levels, chosen=chosen).collect()}
    assert some == {0: [every[0][3]], 2: [every[2][0]], 9: [every[9][2]]}


def test_group_parameters_do_not_move_cells(spark):
    """Cells meet their group's row by broadcast: no sort and no exchange by group comes between the scan and the counts."""
    from lamella.operators import threshold as T

    df = spark.range(4000).selectExpr("id % 3 AS core", "CAST(id % 1000 AS DOUBLE) AS v")
    plan = T.percentiles(df, "v", ["core"], [0.25, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_hull_of_crowded_planes_keeps_few_corners():
    """Points on the planes of a box are no corners, in whatever order they come; the volume is the box's."""
    import numpy as np
    from lamella.operators import aggregate as A

    rng = np.random.default_rng(5)
    box = np.array([[x, y, z * 4.5] for x in range(30) for y in range(30) for z in range(7)], dtype=float)[rng.permutation(6300)]
    ends = A.line_ends(box)
    assert len(ends) == 8 and abs(A.hull_volume(ends) - 29 * 29 * 27) < 1e-6 and abs(A.hull_volume(box) - 29 * 29 * 27) < 1e-6
    assert len(np.unique(A.hull_faces(box))) < 100


def test_pages_are_parsed_in_many_tasks(spark):
    from lamella.sources import catalog as C

    xml = spark.createDataFrame([(i, f"<P><Name>n{i}</Name><Fluor></Fluor></P>") for i in range(40)] + [(98, "<P><ImageType>Thumbnail</ImageType><Name>x</Name></P>"), (99, None)], "file_id long, xml string")
    out = C.channel_metadata(xml)
    assert sorted((r.file_id, r.Name, r.Fluor, r.Color) for r in out.collect()) == [(i, f"n{i}", None, None) for i in range(40)]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
