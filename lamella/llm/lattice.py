"""Near-duplicate vectors: random projections decoded to E8 lattice points, neighbouring cells probed, cosines verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import components, cut, sliced, stored

#: Lattice points a table joins to one cell: 16 projections.
POINTS = 2
#: Rows of a block; larger cells and components are compared block by block.
BLOCK = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or eight halves with an even number of minus signs."""
    whole = [np.bincount(pair, signs, 8) for pair in combinations(range(8), 2) for signs in product((1, -1), repeat=2)]
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + halves)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: of an odd sum the worst rounded coordinate goes the other way."""
    points = np.rint(x)
    off = x - points
    odd = np.flatnonzero(points.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    points[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return points


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: E8 is D8 and D8 moved by one half in every coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of length one. A power of two is taken out first, so that no square overflows or vanishes."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def lattice_cells(units: np.ndarray, reach: float, tables: int, probes: int, seed: int) -> np.ndarray:
    """Hashed cells of each row, ``tables * (probes + 1)`` columns: its own and the ``probes`` nearest ones of each table.

    A cell is ``POINTS`` lattice points of 8 projections each, scaled so that rows within ``reach`` lie a fraction of a
    cell apart. Neighbouring cells move one of the points by a shortest vector of the lattice, nearest first.
    """
    shortest, out = roots(), []
    for table in range(tables):
        rng = np.random.default_rng([seed, table, units.shape[1]])
        seen = units @ rng.normal(size=(units.shape[1], 8 * POINTS)) / (6 * reach)
        factors = rng.integers(1, 2**63, size=(8 * POINTS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        points = np.hstack([nearest_e8(seen[:, at : at + 8]) for at in range(0, 8 * POINTS, 8)])
        # Twice a point is whole; a linear hash needs only the shortest vector's own hash for each neighbour.
        own = (2 * points).astype(np.int64).view(np.uint64) @ factors
        moves = (2 * shortest).astype(np.int64).view(np.uint64)
        steps = np.vstack([moves @ factors[at : at + 8] for at in range(0, 8 * POINTS, 8)]).ravel()
        gain = np.hstack([(seen - points)[:, at : at + 8] @ shortest.T for at in range(0, 8 * POINTS, 8)])
        nearest = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(units), 0), dtype=int)
        out.append(np.hstack([own, own + steps[nearest]]) ^ rng.integers(0, 2**64, dtype=np.uint64))
    mixed = np.hstack(out) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(29)


def _groups(members: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Rows of ``members(cell, node, n)``, with their vectors, dealt into bounded groups ``(tile, lo, hi)``.

    Cells of at most an eighth of a block share groups by hash, about a block in each. Larger ones are dealt over blocks
    of about ``block`` rows, and every two blocks of a cell meet in one group.
    """
    small = F.col("n") <= block // 8
    rows = members.where(small).count()
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "cell"), blocks).cast("int")
    with_vectors = members.join(classes.select("node", "kind", "width", "vector", "n_rows"), "node")
    together = with_vectors.where(small).select("*", F.pmod(F.xxhash64("cell"), F.lit(rows // block + 1)).alias("tile"), F.lit(-1).alias("own"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    dealt = with_vectors.where(~small).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    apart = dealt.select(*with_vectors.columns, F.col("cell").alias("tile"), "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return together.unionByName(apart).drop("n")


def _linked(table: pa.Table, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(left, right, linked)`` of a group: row numbers of its two blocks, or of all its rows twice, and which are linked."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    same = {c: column[c].to_numpy() for c in ("cell", "kind", "width", "node", "own")}
    for width in np.unique(same["width"]):
        rows = np.flatnonzero(same["width"] == width)
        units = unit_rows(column["vector"].take(pa.array(rows)), int(width))
        lo, hi = column["lo"][0].as_py(), column["hi"][0].as_py()
        left, right = (np.flatnonzero(same["own"][rows] == lo), np.flatnonzero(same["own"][rows] == hi)) if lo < hi else (np.arange(len(rows)),) * 2
        linked = units[left] @ units[right].T >= cosine
        left, right = rows[left], rows[right]
        for c in ("cell", "kind"):
            linked &= same[c][left][:, None] == same[c][right]
        linked &= same["node"][left][:, None] != same["node"][right]
        yield left, right, linked


def _forest(cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Edges ``(a, b)`` that connect what the links of a group connect, one for each row at most."""

    def within(table: pa.Table) -> pa.Table:
        nodes, least = table.column("node").to_numpy(), np.arange(table.num_rows)
        for left, right, linked in _linked(table, cosine):
            while True:
                before = least.copy()
                to_left = np.where(linked, least[right], len(least)).min(axis=1, initial=len(least))
                least[left] = np.minimum(least[left], to_left)
                to_right = np.where(linked, least[left][:, None], len(least)).min(axis=0, initial=len(least))
                least[right] = np.minimum(least[right], to_right)
                least = least[least]
                if (before == least).all():
                    break
        tied = np.flatnonzero(least != np.arange(len(least)))
        return pa.table({"a": nodes[tied], "b": nodes[least[tied]]})

    return within


def _counts(cosine: float) -> Callable[[pa.Table], pa.Table]:
    """``(node, k)``: rows that each row of a group is linked to, copies counted."""

    def within(table: pa.Table) -> pa.Table:
        nodes, rows = table.column("node").to_numpy(), table.column("n_rows").to_numpy()
        k = np.zeros(len(nodes), dtype=np.int64)
        for left, right, linked in _linked(table, cosine):
            k[left] += linked @ rows[right]
            if table.column("lo")[0].as_py() < table.column("hi")[0].as_py():
                k[right] += rows[left] @ linked
        some = np.flatnonzero(k)
        return pa.table({"node": nodes[some], "k": k[some]})

    return within


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    tables: int = 5, probes: int = 6, block: int = BLOCK, seed: int = 13,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: links are equal labels and a cosine of ``cosine`` or more.

    Vectors of one cell in one of ``tables`` tables, their own or a probed one, are candidates; a cell's members are
    compared block by block and give a spanning forest of their verified links, never its pairs. Links are then counted
    over all members of each component, so a pair that no cell showed counts as long as links connect it. Equal vectors
    are one class with a number of rows: each is linked to the other copies. At a cosine of just 0.98 a cell is shared
    with a probability of about 0.9998, above it more often.

    A null label, a null, empty or zero vector, or a null or non-finite component: no link, a component of its own.
    Vectors of different lengths are not linked. Repeated rows are copies of one another. A null ``vec_id`` keeps its row
    and names a component only if all ids there are null. An empty table gives an empty result; other columns are ignored.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    x = F.col("vector")
    fit = F.col("label").isNotNull() & F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label")).withColumn("fit", fit)
    keyed = rows.where("fit").select("vec_id", "vector", F.xxhash64("label").alias("kind"), F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(seed), "vector", "label").alias("h2"))
    grouped = keyed.groupBy("h1", "h2", "kind").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("n_rows"))
    # The number of a class is written with it, so later reads agree on it.
    classes = stored(grouped.withColumn("width", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "lattice-classes")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                of = batch.take(pa.array(np.flatnonzero(widths == width)))
                cells = lattice_cells(unit_rows(of.column("vector"), int(width)), reach, tables, probes, seed)
                cells = (cells ^ of.column("kind").to_numpy().view(np.uint64)[:, None]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of.column("node").to_numpy(), tables * (probes + 1))), pa.array(cells)], names=["node", "cell"])

    cells = stored(classes.select("node", "kind", "width", "vector").mapInArrow(emit, "node long, cell long"), "lattice-cells")
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(cells.join(shared, "cell"), "lattice-shared")
    groups = _groups(members, classes, block)
    edges = groups.groupBy("tile", "lo", "hi").applyInArrow(_forest(cosine), "a long, b long")
    found = cut(components(edges).withColumnRenamed("component", "cell"))
    sizes = cut(found.groupBy("cell").agg(F.count("*").alias("n")))
    linked = _groups(stored(found.join(sizes, "cell"), "lattice-found"), classes, block)
    counts = cut(linked.groupBy("tile", "lo", "hi").applyInArrow(_counts(cosine), "node long, k long").groupBy("node").agg(F.sum("k").alias("k")))
    placed = classes.select("node", "h1", "h2", "kind", "first_id", "n_rows").join(found, "node", "left").join(counts, "node", "left")
    placed = stored(placed.withColumn("cell", F.coalesce("cell", "node")), "lattice-placed")
    named = cut(placed.groupBy("cell").agg(F.min("first_id").alias("component_id")))
    judged = stored(placed.join(named, "cell").select("h1", "h2", "kind", (F.coalesce("k", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "component_id"), "lattice-judged")
    told = keyed.join(judged, ["h1", "h2", "kind"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
