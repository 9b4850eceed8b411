import math
import random

import numpy as np
import pytest
from lamella.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int"


def plain(rows, every=50, positives=5, negatives_=3, low=50, high=95):
    fit = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in fit]
    out = []
    for i, v, label in fit:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in fit)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            near = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(out)


def result(spark, rows, **kw):
    df = negatives.hard_negatives(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), **kw)
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 3, 5), (64, 64, 64), (65, 33, 70), (130, 5, 131), (3, 200, 2)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    for most in (3, 2**20, 2**40):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T] for row in a], dtype=object)
        got = negatives.strassen(a, b, 4)
        assert all(int(g) == (w + 2**63) % 2**64 - 2**63 for g, w in zip(got.ravel(), want.ravel()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [[rng.gauss(0, 0.3) for _ in range(9)] for _ in range(12)]
    out = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(base)], rng.randrange(4)) for i in range(400)]
    out += [(400 + i, list(base[0]), i % 2) for i in range(120)]  # ties in every heap
    out += [(950, None, 1), (951, [], 1), (952, [1.0], None), (953, [1.0, None], 1), (954, [math.nan], 1), (955, [math.inf] * 9, 1), (None, [1.0] * 9, 1)]
    return out + [(1000, [2.0, 1.0], 1), (1001, [3.0], 1), (1050, [0.0] * 9, 2), *out[50:60], *out[100:101], (-50, base[1], 3)]


@pytest.mark.parametrize("tile", [1024, 16])
def test_against_brute_force(spark, rows, tile):
    got = result(spark, rows, tile=tile)
    assert got == plain(rows)
    assert len(got) > 60


def test_other_windows_and_heaps(spark, rows):
    assert result(spark, rows, every=7, positives=2, negatives=4, low=20, high=100, tile=64) == plain(rows, 7, 2, 4, 20, 100)


def test_labels_are_moved(spark):
    df = negatives.moved_labels(spark.createDataFrame([(7, 9), (14, None), (8, 3), (None, 4)], "vec_id long, label int"))
    assert sorted(map(tuple, df.collect()), key=repr) == [(14, None), (7, 0), (8, 3), (None, 4)]


def test_scores_near_the_limit_are_exact_and_beyond_it_an_error(spark):
    big = 2.0**22
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big * 0.75, 7.0], 2)]
    assert result(spark, rows) == plain(rows) != []
    with pytest.raises(Exception, match="64 bits"):
        result(spark, [(0, [2.0**40] * 3, 1), (1, [2.0**40] * 3, 1)])


def test_empty_table_and_no_anchor(spark):
    assert result(spark, []) == [] == result(spark, [(1, [1.0], 1), (2, [1.0], 2)])
