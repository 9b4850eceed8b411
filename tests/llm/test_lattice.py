import itertools
import math
import random

import numpy as np
import pytest
from lamella.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label string, node long, n long, kept int"


def plain(rows, cosine=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        most = max(map(abs, v))
        return [x / most / math.sqrt(sum((y / most) ** 2 for y in v)) for x in v]

    units = [unit(v) for _, v, _ in rows]
    linked = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a and b and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and sum(x * y for x, y in zip(a, b)) >= cosine:
            linked[i].add(j), linked[j].add(i)
    root = {}
    for i in linked:
        todo, seen = [i], {i}
        while todo:
            todo += [j for j in linked[todo.pop()] if j not in seen and not seen.add(j)]
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((rows[i][0], len(linked[i]), root[i], rows[i][0] == root[i]) for i in linked), key=repr)


def result(spark, rows, **kw):
    df = lattice.near_duplicates(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA), **kw)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_e8_points_are_nearest():
    shortest = lattice.roots()
    assert len({tuple(r) for r in shortest}) == 240 and np.allclose((shortest**2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 3
    points = lattice.nearest_e8(x)
    assert (points * 2 == np.rint(points * 2)).all() and (points.sum(axis=1) % 2 == 0).all()
    own = ((x - points) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # no place lies farther than 1 from the lattice
    for step in shortest:
        assert (own <= ((x - points - step) ** 2).sum(axis=1) + 1e-9).all()
    assert (lattice.nearest_e8(points + 1e-3) == points).all()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)

    def near(v, by):
        return [x + rng.gauss(0, by) for x in v]

    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    out = [(i, near(rng.choice(base), rng.choice([0.02, 0.1, 0.16])), rng.choice("ab")) for i in range(300)]
    out += [(1000 + i, near(base[0], 0.05), "a") for i in range(150)]  # a dense group
    out += [(2000 + i, list(base[1]), "b") for i in range(60)]  # copies
    out += [(2100, [3 * x for x in base[1]], "b"), (2101, [-x for x in base[1]], "b"), (2102, [1e-200 * x for x in base[1]], "b"), (2103, [1e200 * x for x in base[1]], "b")]
    chain = [[math.cos(t * 0.19), math.sin(t * 0.19)] + [0.0] * 14 for t in range(14)]  # each linked to the next only
    out += [(3000 - i, v, "a") for i, v in enumerate(chain)]
    out += [(4000, None, "a"), (4001, [], "a"), (4002, [0.0] * 16, "a"), (4003, [0.0] * 16, "a"), (4004, [math.nan] * 16, "a"), (4005, [1.0, None], "a"), (4006, [math.inf] * 16, "a")]
    out += [(4010, base[2], None), (4011, base[2], None), (4012, [1.0, 2.0], "a"), (4013, [1.0, 2.0, 0.0], "a"), (4014, [2.0, 4.0], "a")]
    return out + [(None, base[3], "a"), (4020, base[3], "a"), (None, [9.0] + base[4][1:], "c"), (None, None, None), out[0], out[0]]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, rows, block):
    got = result(spark, rows, block=block)
    want = [(i, n, c, i is None and c is None or k) for i, n, c, k in plain(rows)]
    assert got == sorted(want, key=repr)
    assert max(n for _, n, *_ in got) > 149


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, in the given number of dimensions: nearly all are found."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(axis=1)[:, None] * a
    off /= np.linalg.norm(off, axis=1)[:, None]
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * off
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.vstack([a, b]))]
    found = [n for _, n, *_ in result(spark, rows)]
    assert sum(found) >= 0.995 * 1200 and max(found) == 1


def test_other_thresholds(spark, rows):
    got = result(spark, rows[:200], cosine=0.9)
    assert got == plain(rows[:200], 0.9)


def test_empty_table(spark):
    assert result(spark, []) == []
