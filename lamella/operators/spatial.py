"""Neighbours in 2-D and 3-D by buckets of space, and interaction scores by permutation of types."""

from __future__ import annotations

import decimal
import math
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lamella.operators import places as crowd
from lamella.operators.lineage import cut


def _distance(dims: Sequence[str], a: str, b: str) -> Column:
    total = F.lit(0.0)
    for d in dims:
        total = total + F.pow(F.col(f"{a}{d}") - F.col(f"{b}{d}"), F.lit(2.0))
    return F.sqrt(total)


def _bucket(d: str, size: Column | float) -> Column:
    return F.floor(F.col(d) / size).cast("long")


def _around(dims: Sequence[str], size: Column | float) -> Column:
    """Buckets at and next to a point, as an array of structs."""
    steps = [F.struct(*[(_bucket(d, size) + s).alias(f"_b{i}") for i, (d, s) in enumerate(zip(dims, offset))]) for offset in product((-1, 0, 1), repeat=len(dims))]
    return F.array(*steps)


#: Cells of a block; blocks of neighbouring tiles meet as arrays, two at a time.
BLOCK = 2048
#: Tiles are widened while they hold fewer cells than this on average, so that sparse cells do not meet one by one.
FILLED = 64


def _farthest(radius: float) -> float:
    """The largest square of a distance that is within ``radius``: its root, rounded, is at most ``radius``."""
    most = float(radius) ** 2
    while math.sqrt(most) > radius:
        most = math.nextafter(most, 0.0)
    while most < math.inf and math.sqrt(math.nextafter(most, math.inf)) <= radius:
        most = math.nextafter(most, math.inf)
    return most


def _sited(points: DataFrame, dims: Sequence[str], item: str) -> DataFrame:
    """Points with an id and a finite place: only they can be near others."""
    finite = [(F.col(d).cast("double") > -math.inf) & (F.col(d).cast("double") < math.inf) for d in dims]
    return points.filter(reduce(lambda p, q: p & q, finite, F.col(item).isNotNull()))


def _meetings(points: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str], item: str, extra: Sequence[str] = (), half: bool = False, told: DataFrame | None = None) -> DataFrame:
    """Blocks of cells, each followed by the blocks that may hold cells within ``radius`` of its own.

    Columns: keys, the block's tile and number (``_m*``), those of the block met (``_b*``, ``_k``), ``_own`` if it is the same, the
    columns of ``told(keys, ...)``, and arrays ``_item``, ``_x*`` and ``extra`` of the block met. A tile is at least ``radius``
    wide and is dealt into blocks of about ``BLOCK`` cells; partitions are sorted, a block's own row first. ``half``
    leaves out meetings of a block with one before it. Cells without an id or a place meet nobody.
    """
    xs, tile = [f"_x{i}" for i in range(len(dims))], [f"_b{i}" for i in range(len(dims))]
    known = _sited(points, dims, item)
    width = float(radius)
    filled = known.groupBy(*keys, *[_bucket(d, width) for d in dims]).agg(F.count("*").alias("_n")).agg(F.avg("_n")).first()[0]
    while filled is not None and filled < FILLED and width < radius * 64:
        width, filled = width * 2, filled * 4
    placed = known.select(*keys, F.col(item).alias("_item"), *extra, *[F.col(d).cast("double").alias(x) for d, x in zip(dims, xs)], *[_bucket(d, width).alias(c) for d, c in zip(dims, tile)])
    counts = placed.groupBy(*keys, *tile).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    dealt = placed.join(counts, [*keys, *tile]).withColumn("_k", F.pmod(F.xxhash64("_item", *xs), F.col("_n")).cast("int"))
    lists = ["_item", *extra, *xs]
    blocks = cut(dealt.groupBy(*keys, *tile, "_k").agg(F.collect_list(F.struct(*lists)).alias("_c")).select(*keys, *tile, "_k", *[F.col("_c").getField(c).alias(c) for c in lists]))
    steps = [o for o in product((-1, 0, 1), repeat=len(dims)) if not half or o >= (0,) * len(dims)]
    names = blocks.select(*keys, *tile, "_k")
    mine = names.select(*keys, *[F.col(c).alias(f"_m{c}") for c in [*tile, "_k"]], F.explode(F.array(*[F.struct(*[(F.col(c) + s).alias(c) for c, s in zip(tile, o)]) for o in steps])).alias("_to"))
    pairs = mine.select(*keys, *[f"_m{c}" for c in [*tile, "_k"]], "_to.*").join(names, [*keys, *tile])
    same = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_m{c}") for c in tile])
    if half:
        pairs = pairs.filter(~same | (F.col("_k") >= F.col("_m_k")))
    pairs = pairs.withColumn("_own", same & (F.col("_k") == F.col("_m_k")))
    if told is not None:
        pairs = pairs.join(told, [*keys])
    met = pairs.join(blocks, [*keys, *tile, "_k"])
    order = [*keys, *[f"_m{c}" for c in [*tile, "_k"]]]
    return met.repartitionByRange(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, F.desc("_own"))


#: Crowded cells are worked off in tiles of so many radii, each with the cells around it.
SPAN = 3
#: A tile with more cells or places than this, those around it left out, is not worked off at once.
MOST_CELLS, MOST_PLACES = 2_000_000, 1_000_000


def _crowded(points: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str], item: str, pair: float, run: float, place: float) -> int:
    """The number of tiles if rows of places (see ``places``) are less work than pairs of cells, else 0.

    ``pair`` is the work of a pair of cells in blocks, ``run`` that of a place and a row near it, ``place`` that of a place. Ids
    that stand at several cells of a group are told apart in pairs of cells only.
    """
    if not radius > 0:
        return 0
    width = float(radius) * SPAN
    rows = F.struct(*[F.col(d).cast("double") for d in dims[1:]]) if len(dims) > 1 else F.lit(0)
    known = _sited(points, dims, item)
    tiles = known.groupBy(*keys, *[_bucket(d, width).alias(f"_b{i}") for i, d in enumerate(dims)]).agg(F.count("*").cast("double").alias("_n"), F.approx_count_distinct(F.col(dims[0]).cast("double")).alias("_x"), F.approx_count_distinct(rows).alias("_r"))
    grid = F.col("_x") * F.col("_r")
    found = tiles.agg(F.count("*").alias("tiles"), F.sum(F.col("_n") * F.col("_n")).alias("pairs"), F.sum(grid * (F.col("_r") * run + place)).alias("runs"), F.max("_n").alias("cells"), F.max(grid).alias("places")).first()
    if not found["tiles"] or found["pairs"] * (3 / SPAN) ** len(dims) * pair <= found["runs"] or found["cells"] > MOST_CELLS or found["places"] > MOST_PLACES:
        return 0
    repeated = known.groupBy(*keys, item).agg(F.count("*").alias("_n")).filter("_n > 1")
    return found["tiles"] if repeated.isEmpty() else 0


def _tiled(points: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str], extra: Sequence[str], told: DataFrame, tiles: int, half: bool = False) -> DataFrame:
    """Rows of each tile one after the other: its group's ``_counts`` of ``told``, its own blocks of points, those next to it.

    Columns: keys, the tile ``_t*``, ``_part`` (0, 1 or 2 for the three), ``_counts``, and arrays ``_x*`` and ``extra`` of a block, which
    is a little over ``radius`` wide; a tile has ``SPAN`` blocks a dimension. With ``half`` blocks below the tile in the last
    dimension are left out.
    """
    width, names, lists = float(radius) * 1.001, [f"_t{i}" for i in range(len(dims))], [*[f"_x{i}" for i in range(len(dims))], *extra]
    blocked = points.groupBy(*keys, *[_bucket(d, width).alias(f"_b{i}") for i, d in enumerate(dims)]).agg(F.collect_list(F.struct(*[F.col(d).cast("double").alias(f"_x{i}") for i, d in enumerate(dims)], *extra)).alias("_c"))
    placed = blocks = cut(blocked.select(*keys, *[f"_b{i}" for i in range(len(dims))], *[F.col("_c").getField(c).alias(c) for c in lists]))
    of = lambda i, step: F.floor((F.col(f"_b{i}") + step) / SPAN).cast("long")
    for i, t in enumerate(names):
        placed = placed.withColumn(t, F.explode(F.sequence(of(i, -1), of(i, 0 if half and i == len(dims) - 1 else 1))))
    own = reduce(lambda p, q: p & q, [F.col(t) == of(i, 0) for i, t in enumerate(names)])
    around = placed.select(*keys, *names, F.when(own, 1).otherwise(2).alias("_part"), F.lit(None).cast(told.schema["_counts"].dataType).alias("_counts"), *lists)
    mine = blocks.select(*keys, *[of(i, 0).alias(t) for i, t in enumerate(names)]).distinct().join(told, [*keys])
    heads = mine.select(*keys, *names, F.lit(0).alias("_part"), "_counts", *[F.lit(None).cast(around.schema[c].dataType).alias(c) for c in lists])
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles, 1024))
    return heads.unionByName(around).repartitionByRange(parts, *keys, *names).sortWithinPartitions(*keys, *names, "_part")


def _each_tile(batches: Iterator[pa.RecordBatch], keys: Sequence[str], dims: int, extra: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Keys, counts, own or not, places and ``extra`` of each tile of ``_tiled`` that has cells of its own."""
    for rows in crowd.gathered(batches, [*keys, *[f"_t{i}" for i in range(dims)]]):
        if rows.column("_part")[0].as_py() == 0 and rows.num_rows > 1:
            held = rows.slice(1)
            get = lambda c: np.concatenate([a.flatten().to_numpy() for a in held.column(c).chunks])  # noqa: E731, B023
            sizes = np.concatenate([a.value_lengths().to_numpy() for a in held.column("_x0").chunks])
            own = np.repeat(held.column("_part").to_numpy() == 1, sizes)
            yield tuple(rows.column(k)[0].as_py() for k in keys), np.asarray(rows.column("_counts")[0].as_py()), own, [get(f"_x{i}") for i in range(dims)], [get(c) for c in extra]


def _unpacked(batches: Iterator[pa.RecordBatch], heads: Sequence[str], lists: Sequence[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Rows of ``_meetings``: the values of ``heads`` and the arrays of ``lists``."""
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in heads]
        arrays = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in lists]
        for i, head in enumerate(zip(*values)):
            yield head, [v[at[i] : at[i + 1]] for at, v in arrays]


def _squares(mine: Sequence[np.ndarray], theirs: Sequence[np.ndarray], ids: np.ndarray, their_ids: np.ndarray, most: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, squared distances and nearness, for some rows of ``mine`` at a time; an id is never near itself."""
    shared = len(np.intersect1d(ids, their_ids)) > 0
    step = max(1, 131_072 // max(1, len(their_ids)))
    for first in range(0, len(ids), step):
        total = np.zeros((min(step, len(ids) - first), len(their_ids)))
        for p, q in zip(mine, theirs):
            d = p[first : first + step, None] - q
            d *= d
            total += d
        near = total <= most
        if shared:
            near &= ids[first : first + step, None] != their_ids
        yield first, total, near


def _rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """``values``, 0 or more, to ``digits`` decimals as Spark rounds them: halves of their shortest decimal form go up."""
    scaled = values * 10.0**digits
    out = np.rint(scaled)
    # Beyond doubt unless next to a half or too large to tell; the quotient is the double nearest to the decimal.
    unsure = np.flatnonzero((np.abs(np.abs(scaled - out) - 0.5) < 1e-3) | ~(scaled < 2.0**40))
    out /= 10.0**digits
    for i in unsure:
        if math.isfinite(values[i]):
            with decimal.localcontext(prec=800):
                out[i] = float(decimal.Decimal(repr(float(values[i]))).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP))
        else:
            out[i] = values[i]
    return out


def radius_graph(points: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str] = ("core",), item: str = "cell_id", digits: int | None = None) -> DataFrame:
    """Ordered pairs of different points within ``radius``, inclusive: (keys, src, dst, dist), ``dist`` to ``digits`` decimals if given.

    Blocks of neighbouring tiles meet as arrays (see ``_meetings``), so what is shuffled follows the points and not the pairs.
    """
    keys, xs, most = [*keys], [f"_x{i}" for i in range(len(dims))], _farthest(radius)
    met = _meetings(points, radius, dims, keys, item)
    kind = met.schema["_item"].dataType.elementType.simpleString()
    schema = "".join(f"`{k}` {met.schema[k].dataType.simpleString()}, " for k in keys) + f"src {kind}, dst {kind}, dist double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[np.ndarray] = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            item_kind = batch.schema.field("_item").type.value_type
            for (own, *key), met_ in _unpacked([batch], ["_own", *keys], ["_item", *xs]):
                mine = met_ if own else mine
                for first, square, near in _squares(mine[1:], met_[1:], mine[0], met_[0], most):
                    a, b = np.nonzero(near)
                    if len(a):
                        dist = np.sqrt(square[near])
                        columns = [pa.repeat(pa.scalar(v, t), len(a)) for v, t in zip(key, kinds)]
                        columns += [pa.array(mine[0][a + first], item_kind), pa.array(met_[0][b], item_kind), pa.array(_rounded(dist, digits) if digits is not None else dist)]
                        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "src", "dst", "dist"])

    return met.mapInArrow(pairs, schema)


def _listed(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Types of each group, sorted, and how many cells bear them: (keys, _types, _counts)."""
    kinds = cells.groupBy(*keys, "cell_type").agg(F.count("*").alias("_n"))
    listed = kinds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell_type", "_n"))).alias("_k"))
    return listed.select(*keys, F.transform("_k", lambda k: k["cell_type"]).alias("_types"), F.transform("_k", lambda k: k["_n"]).alias("_counts"))


def neighbour_totals(cells: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str] = ("core",), item: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Neighbours within ``radius`` counted without ever being rows: (keys, src_type, tgt_type, n_pairs) and (keys, n, fan).

    ``n`` counts a group's ordered pairs, ``fan`` is the sum of d * (d - 1) over the numbers d of a cell's neighbours.
    """
    keys = [*keys]
    listed = _listed(cells.filter("cell_type IS NOT NULL"), keys)
    typed = cells.join(listed, [*keys]).filter("cell_type IS NOT NULL").withColumn("_type", (F.array_position("_types", F.col("cell_type")) - 1).cast("int"))
    tiles = _crowded(typed, radius, dims, keys, item, 6.0, 3.0, 100.0)
    counted = cut((_totals_by_places(typed, radius, dims, keys, item, listed, tiles) if tiles else _totals_by_cells(typed, radius, dims, keys, item)).groupBy(*keys, "_s", "_d").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("_fan").alias("_fan")))
    named = counted.filter("_s >= 0").join(listed, [*keys]).select(*keys, F.get("_types", F.col("_s")).alias("src_type"), F.get("_types", F.col("_d")).alias("tgt_type"), "n_pairs")
    return named, counted.filter("_s < 0").select(*keys, F.col("n_pairs").alias("n"), F.col("_fan").alias("fan"))


def _totals_by_places(typed: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str], item: str, listed: DataFrame, tiles: int) -> DataFrame:
    """Tallies of tasks, (keys, _s, _d, n_pairs, _fan), from the numbers of cells of each type at each place."""
    keys, most = [*keys], _farthest(radius)
    places = _sited(typed, dims, item).groupBy(*keys, *dims, "_type").agg(F.count("*").alias("_n"))
    met = _tiled(places, radius, dims, keys, ["_type", "_n"], listed.select(*keys, "_counts"), tiles)
    schema = "".join(f"`{k}` {met.schema[k].dataType.simpleString()}, " for k in keys) + "_s int, _d int, n_pairs bigint, _fan bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, counts, own, coords, (kinds, many) in _each_tile(batches, keys, len(dims), ["_type", "_n"]):
            width = len(counts)
            pairs, total, fan = crowd.tallied(own, coords, kinds, many, width, most)
            out = [(*key, s, d, int(pairs[s, d]), 0) for s in range(width) for d in range(width) if pairs[s, d]] + [(*key, -1, -1, total, fan)]
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "_s", "_d", "n_pairs", "_fan"], r)) for r in out], schema=arrow)

    return met.mapInArrow(tally, schema)


def _totals_by_cells(typed: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str], item: str) -> DataFrame:
    """As ``_totals_by_places``, from pairs of blocks of cells."""
    keys, xs, most = [*keys], [f"_x{i}" for i in range(len(dims))], _farthest(radius)
    met = _meetings(typed, radius, dims, keys, item, ["_type"])
    schema = "".join(f"`{k}` {met.schema[k].dataType.simpleString()}, " for k in keys) + "_s int, _d int, n_pairs bigint, _fan bigint"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[tuple[int, int], list[int]]] = {}
        mine, degree, group, kinds = [], np.zeros(0, dtype=np.int64), (), []

        def closed() -> None:
            total = sums.setdefault(group, {}).setdefault((-1, -1), [0, 0])
            total[0] += int(degree.sum())
            total[1] += int((degree * (degree - 1)).sum())

        def rows() -> pa.RecordBatch:
            out = [(*key, s, d, n, fan) for key, total in sums.items() for (s, d), (n, fan) in total.items()]
            types = [*kinds, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*keys, "_s", "_d", "n_pairs", "_fan"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for (own, *key), met_ in _unpacked([batch], ["_own", *keys], ["_item", "_type", *xs]):
                if own:
                    if len(mine):
                        closed()
                    if len(sums) > 1000:
                        yield rows()
                        sums.clear()
                    mine, degree, group = met_, np.zeros(len(met_[0]), dtype=np.int64), tuple(key)
                theirs = np.unique(met_[1])
                bears = (met_[1][:, None] == theirs).astype(np.float32)
                found = np.concatenate([near.astype(np.float32) @ bears for _, _, near in _squares(mine[2:], met_[2:], mine[0], met_[0], most)]).astype(np.int64)
                degree += found.sum(axis=1)
                for s in np.unique(mine[1]):
                    for d, n in zip(theirs, found[mine[1] == s].sum(axis=0)):
                        if n:
                            sums.setdefault(group, {}).setdefault((int(s), int(d)), [0, 0])[0] += int(n)
        if len(mine):
            closed()
        if sums:
            yield rows()

    return met.mapInArrow(tally, schema)


def _paired(open_: DataFrame, goal: DataFrame, dims: Sequence[str], keys: Sequence[str], item: str, width: float) -> DataFrame:
    """Sources with the targets in the 3^d buckets around them, self excluded: (keys, item, rest of goal, _d)."""
    left = open_.select(*keys, F.col(item), *[F.col(d).alias(f"_s{d}") for d in dims], F.explode(_around(dims, F.lit(width))).alias("_b"))
    right = goal.select(*[c for c in goal.columns if c not in (item, *dims)], F.col(item).alias("_o"), *[F.col(d).alias(f"_t{d}") for d in dims], F.struct(*[_bucket(d, F.lit(width)).alias(f"_b{j}") for j, d in enumerate(dims)]).alias("_b"))
    return left.join(right, [*keys, "_b"]).filter(F.col(item) != F.col("_o")).withColumn("_d", _distance(dims, "_s", "_t"))


def _tiles(goal: DataFrame, dims: Sequence[str], keys: Sequence[str], item: str, width: float, finer: float | None) -> DataFrame:
    """Occupied tiles of ``width`` with two of their targets: (keys, _up, _b, _p), ``_up`` the tile of twice the width."""
    tile = F.struct(*[_bucket(d, F.lit(width)).alias(f"_b{j}") for j, d in enumerate(dims)])
    up = F.struct(*[_bucket(d, F.lit(finer or width)).alias(f"_b{j}") for j, d in enumerate(dims)])
    point = F.struct(F.col(item), *dims)
    grouped = goal.groupBy(*keys, up.alias("_up"), tile.alias("_b")).agg(F.min(point).alias("_lo"), F.max(point).alias("_hi"))
    return grouped.select(*keys, "_up", "_b", F.array("_lo", "_hi").alias("_p"))


def _descend(open_: DataFrame, goal: DataFrame, dims: Sequence[str], keys: Sequence[str], item: str, width: float, levels: int) -> DataFrame:
    """Nearest targets by halving tiles from ``width`` on: (keys, item, dist).

    A source keeps the tiles whose nearest corner is no farther than the nearest target known so far, each tile showing two
    of its targets; their quarters come next. So far clusters cost a few rows a source and level, never a product. In the
    last, narrowest tiles all targets are compared; equal points count once.
    """
    goal = _two_a_place(goal, dims, keys, item)
    source = open_.select(*keys, item, *dims)
    held = None
    for level in range(levels):
        tiles = _tiles(goal, dims, keys, item, width, width * 2 if level else None)
        asked = source.join(tiles.drop("_up"), [*keys]) if held is None else held.join(tiles, [*keys, "_up"])
        gap = lambda d, j: F.greatest(F.col("_b")[f"_b{j}"] * width - F.col(d), F.col(d) - (F.col("_b")[f"_b{j}"] + 1) * width, F.lit(0.0))  # noqa: E731, B023
        low = F.sqrt(sum((F.pow(gap(d, j), F.lit(2.0)) for j, d in enumerate(dims)), F.lit(0.0)))
        to = lambda p: F.when(p[item] != F.col(item), F.sqrt(sum((F.pow(p[d] - F.col(d), F.lit(2.0)) for d in dims), F.lit(0.0))))
        met = cut(asked.select(*keys, item, *dims, "_b", low.alias("_low"), F.array_min(F.array_compact(F.transform("_p", to))).alias("_known")))
        best = met.groupBy(*keys, item).agg(F.min("_known").alias("_best"))
        held = met.join(best, [*keys, item]).filter(F.col("_best").isNull() | (F.col("_low") <= F.col("_best"))).select(*keys, item, *dims, F.col("_b").alias("_up"))
        width /= 2
    last = goal.select(*keys, F.col(item).alias("_o"), *[F.col(d).alias(f"_t{d}") for d in dims], F.struct(*[_bucket(d, F.lit(width * 2)).alias(f"_b{j}") for j, d in enumerate(dims)]).alias("_up"))
    pairs = held.select(*keys, item, *[F.col(d).alias(f"_s{d}") for d in dims], "_up").join(last, [*keys, "_up"]).filter(F.col(item) != F.col("_o"))
    return pairs.groupBy(*keys, item).agg(F.min(_distance(dims, "_s", "_t")).alias("dist"))


def _width(places: DataFrame, dims: Sequence[str], keys: Sequence[str], size: float, most: float = 8.0) -> float:
    """``size`` or a part of it by a power of two, where a place shares its tile with about ``most`` places on average."""
    for _ in range(20):
        tiles = places.groupBy(*keys, *[_bucket(d, size).alias(f"_b{i}") for i, d in enumerate(dims)]).agg(F.count("*").cast("double").alias("_n"))
        shared = tiles.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0]
        if shared is None or shared <= most:
            break
        size /= 2.0 ** max(1, int(math.log2(shared / most) / len(dims)))
    return size


def _two_a_place(goal: DataFrame, dims: Sequence[str], keys: Sequence[str], item: str) -> DataFrame:
    """The first and last target of each place: more of them are no nearer to anybody."""
    unique = goal.groupBy(*keys, *dims).agg(F.min(item).alias("_a"), F.max(item).alias("_z"))
    return cut(unique.select(*keys, *dims, F.explode(F.array_distinct(F.array("_a", "_z"))).alias(item)))


def nearest_neighbour(src: DataFrame, tgt: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("core",), size: float = 50.0, item: str = "cell_id", rounds: int = 2, levels: int = 20) -> DataFrame:
    """Distance from every source to its nearest target in the same group, not counting itself: (keys, item, dist).

    ``keys`` may hold pairs of types. A distance found in the 3^d buckets around a source is final if it is at most the
    bucket's size, for then no nearer target can lie beyond. Buckets start at ``size`` or, among crowded targets, at the part
    of it that holds a few (see ``_width``). After ``rounds`` of doubled buckets the few that are left
    descend a hierarchy of tiles, from ``size`` * 2^(``levels`` - 4) down to an eighth of ``size``. A source whose group
    has no other target is dropped beforehand. Coincident points of another id count, with distance 0.
    """
    others = tgt.groupBy(*keys).agg(F.min(item).alias("_only"), F.max(item).alias("_last"))
    usable = src.join(others, [*keys]).filter((F.col("_last") != F.col("_only")) | (F.col("_only") != F.col(item))).select(*keys, item, *dims)
    open_, goal, found = cut(usable), _two_a_place(tgt, dims, keys, item), None
    top, size = float(size) * 2 ** (levels - 4), _width(goal.select(*keys, *dims).distinct(), dims, keys, float(size))
    for i in range(rounds):
        width = float(size * 2**i)
        least = _paired(open_, goal, dims, keys, item, width).groupBy(*keys, item).agg(F.min("_d").alias("dist"))
        final = cut(least.filter(F.col("dist") <= width))
        found = final if found is None else found.unionByName(final)
        open_ = cut(open_.join(final, [*keys, item], "left_anti"))
        if open_.isEmpty():
            return found
    last = _descend(open_, goal, dims, keys, item, top, 4 + round(math.log2(top / size)))
    return last if found is None else found.unionByName(last)


def type_distances(cells: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("core", "slice_id"), size: float = 50.0, item: str = "cell_id") -> DataFrame:
    """Nearest-neighbour distances for every ordered pair of types present in a group: (keys, src_type, tgt_type, item, dist).

    A cell meets the cells of all types around it in one join; only pairs of a cell and a type that this leaves open are
    searched for one by one.
    """
    goal = _two_a_place(cells.select(*keys, F.col("cell_type").alias("tgt_type"), item, *dims), dims, [*keys, "tgt_type"], item)
    size = _width(goal.select(*keys, *dims).distinct(), dims, keys, float(size))
    near = _paired(cells.select(*keys, item, *dims), goal, dims, keys, item, float(size))
    final = cut(near.groupBy(*keys, item, "tgt_type").agg(F.min("_d").alias("dist")).filter(F.col("dist") <= size))
    types = cells.select(*keys, F.col("cell_type").alias("tgt_type")).distinct()
    typed = cells.select(*keys, F.col("cell_type").alias("src_type"), item, *dims)
    rest = typed.join(types, [*keys]).join(final, [*keys, item, "tgt_type"], "left_anti")
    by_type = [*keys, "tgt_type"]
    far = nearest_neighbour(rest.select(*by_type, item, *dims), goal, dims, by_type, size * 2, item, 1)
    both = final.unionByName(far).join(typed.select(*keys, item, "src_type"), [*keys, item])
    return both.select(*keys, "src_type", "tgt_type", item, "dist")


def colocalise(a: DataFrame, b: DataFrame, dims: Sequence[str], radius: float | None = None, keys: Sequence[str] = ("core",), size: float = 50.0, item: str = "cell_id") -> DataFrame:
    """Distance from each cell of one channel to the nearest of another; with ``radius`` also whether it is that near.

    Cells of two channels are never the same cell, so equal ids do not exclude each other.
    """
    apart = nearest_neighbour(a.withColumn(item, F.col(item) * 2), b.withColumn(item, F.col(item) * 2 + 1), dims, keys, size, item)
    out = apart.withColumn(item, F.floor(F.col(item) / 2).cast("long"))
    return out if radius is None else out.withColumn("colocalised", F.col("dist") <= radius)


def observed_interactions(cells: DataFrame, graph: DataFrame, keys: Sequence[str] = ("core",), item: str = "cell_id") -> DataFrame:
    """Mean number of neighbours of each type around a cell of each type, pairs without any included."""
    src = cells.select(*keys, F.col(item).alias("src"), F.col("cell_type").alias("src_type"))
    dst = cells.select(*keys, F.col(item).alias("dst"), F.col("cell_type").alias("tgt_type"))
    return _over_grid(cells, graph.join(src, [*keys, "src"]).join(dst, [*keys, "dst"]).groupBy(*keys, "src_type", "tgt_type").agg(F.count("*").alias("n_pairs")), keys)


def observed_within(cells: DataFrame, radius: float, dims: Sequence[str], keys: Sequence[str] = ("core",), item: str = "cell_id") -> DataFrame:
    """As ``observed_interactions`` on the graph of cells within ``radius``, whose pairs are never rows."""
    return _over_grid(cells, neighbour_totals(cells, radius, dims, keys, item)[0], keys)


def _over_grid(cells: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts(keys, src_type, tgt_type, n_pairs)`` for all pairs of a group's types, and per source cell."""
    kinds = cells.groupBy(*keys, "cell_type").agg(F.count("*").alias("n"))
    grid = kinds.select(*keys, F.col("cell_type").alias("src_type"), F.col("n").alias("n_src")).join(kinds.select(*keys, F.col("cell_type").alias("tgt_type")), [*keys])
    joined = grid.join(counts, [*keys, "src_type", "tgt_type"], "left").fillna({"n_pairs": 0})
    return joined.withColumn("observed", F.col("n_pairs") / F.col("n_src"))


def numbered(cells: DataFrame, keys: Sequence[str], item: str, dims: Sequence[str] = (), size: float = 200.0) -> DataFrame:
    """A number from 0 without gaps for each cell of its group, (keys, item, _i), given tile by tile.

    Cells are numbered within tiles of space (``dims``), or within 256 shares by hash, and tiles are counted before, so no
    group is sorted as a whole.
    """
    tile = F.struct(*[_bucket(d, size) for d in dims]) if dims else F.struct(F.pmod(F.xxhash64(item), F.lit(256)))
    dealt = cells.select(*keys, item, tile.alias("_tile"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_tile").agg(F.count("*").alias("_n")).select(*keys, "_tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_tile").orderBy(item)))
    return own.join(starts, [*keys, "_tile"]).select(*keys, item, (F.col("_start") + F.col("_r") - 1).alias("_i"))


def permuted(index: np.ndarray, n: int, perms: np.ndarray, seed: int, rounds: int = 8) -> np.ndarray:
    """Places of ``index`` (below ``n``) under the keyed permutations ``perms`` of 0..n-1: a row for each index.

    A Feistel network over the next power of two, 256 at least, whose halves change in turn; results beyond ``n`` go through
    it again, which keeps it one to one. A place needs nothing but its own index, so no permutation is ever laid out as a
    whole. Numbers have 32 bits unless ``n`` needs more.
    """
    bits = max(8, max(int(n) - 1, 1).bit_length())
    low, high, kind, width = bits // 2, bits - bits // 2, *((np.uint32, 32) if bits <= 32 else (np.uint64, 64))
    mask, odd, more = kind((1 << low) - 1), *((kind(0x85EBCA6B), kind(0xC2B2AE35)) if width == 32 else (kind(0xFF51AFD7ED558CCD), kind(0xC4CEB9FE1A85EC53)))
    salts = []
    for r in range(rounds):
        z = (perms.astype(np.uint64) * np.uint64(rounds) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        salts.append(((z ^ (z >> np.uint64(31))) >> np.uint64(64 - width)).astype(kind))

    def once(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        right, left, z, shifted = x & mask, x >> kind(low), np.empty_like(x), np.empty_like(x)
        for r, salt in enumerate(salts):
            read, changed, kept = (left, right, low) if r % 2 else (right, left, high)
            np.add(read, salt[at], out=z)
            z *= odd
            z ^= np.right_shift(z, kind(width // 2 - 1), out=shifted)
            z *= more
            z >>= kind(width - kept)
            changed ^= z
        left <<= kind(low)
        left |= right
        return left

    out = np.empty((len(index), len(perms)), dtype=kind)
    step = min(len(index), max(1, 16_384 // max(1, len(perms))))  # so few that they stay in a core's own memory
    salts = [np.tile(salt, step) for salt in salts]
    for first in range(0, len(index), max(1, step)):
        some = np.repeat(index[first : first + step].astype(kind), len(perms))
        some = once(some, slice(0, len(some)))
        beyond = np.flatnonzero(some >= kind(n)) if int(n) < 1 << bits else np.zeros(0, dtype=np.int64)
        while len(beyond):
            again = once(some[beyond], beyond)
            some[beyond] = again
            beyond = beyond[again >= kind(n)]
        out[first : first + step] = some.reshape(-1, len(perms))
    return out


def _dealt_types(numbers: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Types of the cells of these numbers under ``n`` permutations, a row for each cell; ``bounds`` are running counts of types."""
    out = np.empty((len(numbers), n), dtype=np.uint8 if len(bounds) < 256 else np.int32)
    step = max(1, 500_000 // max(1, len(numbers)))
    for first in range(0, n, step):
        places = permuted(numbers, int(bounds[-1]), np.arange(first, min(n, first + step)), seed)
        if len(bounds) > 32:
            out[:, first : first + step] = np.searchsorted(bounds, places, side="right")
        else:
            out[:, first : first + step] = sum((places >= places.dtype.type(b) for b in bounds[:-1]), np.zeros(places.shape, dtype=np.uint8))
    return out


def _counted(near: np.ndarray, mine: np.ndarray, theirs: np.ndarray, width: int) -> np.ndarray:
    """Near pairs by type of each end under every permutation: (permutations, width, width).

    ``near`` holds 0 and 1, ``mine`` and ``theirs`` the types of its rows and columns, a column for each permutation. Counts of
    several types share a column of the product while their digits fit a single precision number, which keeps them exact;
    the last type's counts are what the others leave.
    """
    degree = near.sum(axis=1, dtype=np.float64).astype(np.float32)
    bits = max(1, int(degree.max(initial=0)).bit_length())
    if bits > 24:
        raise ValueError("a block meets too many cells at once")
    shared = max(1, 24 // bits)
    columns = [range(t, min(t + shared, width - 1)) for t in range(0, width - 1, shared)]
    worth = np.zeros((len(columns), width), dtype=np.float32)
    for c, held in enumerate(columns):
        for k, t in enumerate(held):
            worth[c, t] = 2.0 ** (bits * k)
    total = np.zeros((mine.shape[1], width, width), dtype=np.int64)
    step = max(1, 400_000 // max(1, len(mine), len(theirs)))
    for first in range(0, mine.shape[1], step):
        own, other = mine[:, first : first + step], theirs[:, first : first + step]
        bears = [own == s for s in range(width)]
        rest = np.repeat(degree[:, None], own.shape[1], axis=1)

        def add(t: int, found: np.ndarray) -> None:
            for s, is_s in enumerate(bears):
                total[first : first + step, s, t] = np.einsum("ip,ip->p", found, is_s, dtype=np.float64)  # noqa: B023

        for c, held in enumerate(columns):
            found = near @ worth[c][other]
            for k in reversed(range(len(held))):
                digit = np.floor(found * np.float32(2.0 ** (-bits * k))) if k else found
                if k:
                    found = found - digit * np.float32(2.0 ** (bits * k))
                rest -= digit
                add(held[k], digit)
        add(width - 1, rest)
    return total


def permutation_null(cells: DataFrame, graph: DataFrame, n: int = 1000, seed: int = 42, keys: Sequence[str] = ("core",), item: str = "cell_id", dims: Sequence[str] = ()) -> DataFrame:
    """Sum, sum of squares and exceedances of interactions with types shuffled over a fixed graph ``(keys, src, dst)``.

    Permutation p gives a cell the type that stands at its permuted number in the list of its group's types, sorted by
    type; that list is known from the counts of types alone. Edges carry both ends' numbers; tasks read edges of
    neighbouring cells one batch after the other, work the types of a batch's cells out once for all permutations and
    send on one row per group and pair of types. ``dims`` only serves to keep edges of one place together.
    """
    seen = observed_interactions(cells, graph, keys, item)
    listed = _listed(cells, keys)
    numbers = cut(numbered(cells, keys, item, dims))
    ends = graph.select(*keys, "src", "dst").join(numbers.withColumnsRenamed({item: "src", "_i": "_a"}), [*keys, "src"]).join(numbers.withColumnsRenamed({item: "dst", "_i": "_b"}), [*keys, "dst"])
    dealt = ends.join(listed.select(*keys, "_counts"), [*keys]).select(*keys, "_a", "_b", "_counts").repartitionByRange(*keys, "_a").sortWithinPartitions(*keys, "_a")
    kind = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = [(*key, s, d, total[:, s * w + d]) for key, total in sums.items() for w in [int(total.shape[1] ** 0.5)] for s in range(w) for d in range(w)]
            return pd.DataFrame(out, columns=[*keys, "_s", "_d", "n_pairs"])

        for frame in frames:
            for key, part in frame.groupby([*keys], dropna=False, sort=False):
                counts = np.asarray(part["_counts"].iloc[0])
                width, bounds = len(counts), np.cumsum(counts)
                if key not in sums and len(sums) >= 32:
                    yield rows()
                    sums.clear()
                total = sums.setdefault(key, np.zeros((n, width * width), dtype=np.int64))
                cells_, at = np.unique(np.concatenate([part["_a"], part["_b"]]), return_inverse=True)
                a, b = at[: len(part)], at[len(part) :]
                step = max(1, 2_000_000 // max(len(part), len(cells_)))
                for first in range(0, n, step):
                    perms = np.arange(first, min(n, first + step))
                    types = np.searchsorted(bounds, permuted(cells_, int(bounds[-1]), perms, seed), side="right")
                    code = (types[a] * width + types[b]) + np.arange(len(perms)) * width * width
                    total[perms] += np.bincount(code.ravel(), minlength=len(perms) * width * width).reshape(len(perms), -1)
        if sums:
            yield rows()

    part = dealt.mapInPandas(tally, f"{kind}, _s int, _d int, n_pairs array<bigint>")
    return _exceeded(part, listed, seen, n, keys)


def permutation_null_within(cells: DataFrame, radius: float, dims: Sequence[str], n: int = 1000, seed: int = 42, keys: Sequence[str] = ("core",), item: str = "cell_id") -> DataFrame:
    """As ``permutation_null`` on the graph of cells within ``radius``, whose pairs are never rows; the same permutations.

    Blocks of cells meet as matrices: nearness times the types borne under some permutations gives each cell's neighbours of
    every type under each of them (see ``_counted``). Nearness to some of the blocks met is laid side by side first. The types
    observed are counted on the way. A block's types are worked out once while it stays among the last 128 MB of a task.
    Crowded cells are counted by rows of places instead (see ``places``).
    """
    keys = [*keys]
    listed = cut(_listed(cells, keys))
    named = cells.join(listed, [*keys]).withColumn("_type", F.coalesce(F.array_position("_types", F.col("cell_type")) - 1, F.lit(-1)).cast("int"))
    sited = named.select(*cells.columns, "_type").join(numbered(cells, keys, item, dims), [*keys, item])
    untyped = not cells.filter("cell_type IS NULL").isEmpty()
    tiles = 0 if untyped else _crowded(cells, radius, dims, keys, item, 0.025, 0.125, 40.0)
    part = cut(_drawn_by_places(sited, radius, dims, n, seed, keys, item, listed, tiles) if tiles else _drawn_by_cells(sited, radius, dims, n, seed, keys, item, listed))
    counted = part.groupBy(*keys, "_s", "_d").agg(F.sum(F.element_at("n_pairs", n + 1)).alias("n_pairs"))
    counts = counted.join(listed, [*keys]).select(*keys, F.get("_types", F.col("_s")).alias("src_type"), F.get("_types", F.col("_d")).alias("tgt_type"), "n_pairs")
    return _exceeded(part.withColumn("n_pairs", F.slice("n_pairs", 1, n)), listed, _over_grid(cells, counts, keys), n, keys)


def _drawn_by_places(sited: DataFrame, radius: float, dims: Sequence[str], n: int, seed: int, keys: Sequence[str], item: str, listed: DataFrame, tiles: int) -> DataFrame:
    """Tallies of tasks, (keys, _s, _d, n_pairs), an entry for each permutation and one for the types observed, by rows of places."""
    keys, most = [*keys], _farthest(radius)
    met = _tiled(_sited(sited, dims, item), radius, dims, keys, ["_i", "_type"], listed.select(*keys, "_counts"), tiles, half=True)
    schema = "".join(f"`{k}` {met.schema[k].dataType.simpleString()}, " for k in keys) + "_s int, _d int, n_pairs array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            out = [(*key, s, d, total[:, s, d]) for key, total in sums.items() for s in range(total.shape[1]) for d in range(total.shape[1])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        for key, counts, own, coords, (index, kinds) in _each_tile(batches, keys, len(dims), ["_i", "_type"]):
            bounds = np.cumsum(counts)
            if key not in sums and len(sums) >= 32:
                yield rows()
                sums.clear()
            total = sums.setdefault(key, np.zeros((n + 1, len(bounds), len(bounds)), dtype=np.int64))
            drawn = crowd.Drawn(own, coords, bounds, most)
            index, step = index[drawn.order], drawn.at_once()
            for first in range(0, n, step):
                perms = np.arange(first, min(n, first + step))
                total[perms] += drawn.pairs(permuted(index, int(bounds[-1]), perms, seed))
            total[n] += drawn.pairs((bounds - counts)[kinds[drawn.order]][:, None])[0]
        if sums:
            yield rows()

    return met.mapInArrow(tally, schema)


def _drawn_by_cells(sited: DataFrame, radius: float, dims: Sequence[str], n: int, seed: int, keys: Sequence[str], item: str, listed: DataFrame) -> DataFrame:
    """As ``_drawn_by_places``, from pairs of blocks of cells."""
    keys, xs, most = [*keys], [f"_x{i}" for i in range(len(dims))], _farthest(radius)
    met = _meetings(sited, radius, dims, keys, item, ["_i", "_type"], half=True, told=listed.select(*keys, "_counts"))
    kind = ", ".join(f"`{k}` {met.schema[k].dataType.simpleString()}" for k in keys)
    places = [*[f"_b{i}" for i in range(len(dims))], "_k"]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kept: OrderedDict[tuple, np.ndarray] = OrderedDict()
        mine, own_types, kinds = [], np.zeros((0, 0)), []
        # Nearness of the block's cells to those of other blocks, those cells' types and types observed, not counted yet.
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def types_of(at: tuple, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            if at in kept:
                kept.move_to_end(at)
                return kept[at]
            kept[at] = _dealt_types(numbers, bounds, n, seed)
            while len(kept) > 1 and sum(v.nbytes for v in kept.values()) > 128_000_000:
                kept.popitem(last=False)
            return kept[at]

        def add(total: np.ndarray, own: bool) -> None:
            near, types, seen = (np.concatenate(x, axis=i) for x, i in zip(zip(*waiting), (1, 0, 0)))
            waiting.clear()
            width = total.shape[1]
            found = np.concatenate([_counted(near, own_types, types, width), np.zeros((1, width, width), dtype=np.int64)])
            around = near @ (seen[:, None] == np.arange(width)).astype(np.float32)
            for s in range(width):
                found[n, s] = around[mine[2] == s].sum(axis=0, dtype=np.float64)
            total += found if own else found + found.transpose(0, 2, 1)

        def rows() -> pa.RecordBatch:
            out = [(*key, s, d, total[:, s, d]) for key, total in sums.items() for s in range(total.shape[1]) for d in range(total.shape[1])]
            types = [*kinds, pa.int32(), pa.int32(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*keys, "_s", "_d", "n_pairs"])

        total = np.zeros((0, 0, 0), dtype=np.int64)
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for (own, counts, *at), met_ in _unpacked([batch], ["_own", "_counts", *keys, *places], ["_item", "_i", "_type", *xs]):
                key, bounds = tuple(at[: len(keys)]), np.cumsum(counts)
                if waiting and (own or sum(w[0].shape[1] for w in waiting) + len(met_[0]) > 2 * BLOCK):
                    add(total, False)
                if key not in sums and len(sums) >= 32:
                    yield rows()
                    sums.clear()
                total = sums.setdefault(key, np.zeros((n + 1, len(bounds), len(bounds)), dtype=np.int64))
                if own:
                    mine, own_types = met_, types_of(tuple(at), met_[1], bounds)
                near = np.concatenate([close for _, _, close in _squares(mine[3:], met_[3:], mine[0], met_[0], most)])
                some = np.flatnonzero(near.any(axis=0))
                if len(some):
                    waiting.append((near[:, some].astype(np.float32), types_of(tuple(at), met_[1], bounds)[some], met_[2][some]))
                if own and waiting:
                    add(total, True)
        if waiting:
            add(total, False)
        if sums:
            yield rows()

    return met.mapInArrow(tally, f"{kind}, _s int, _d int, n_pairs array<bigint>")


def _exceeded(part: DataFrame, listed: DataFrame, seen: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Sums over permutations of the tasks' tallies ``part(keys, _s, _d, n_pairs)``, an entry a permutation."""
    each = part.select(*keys, "_s", "_d", F.posexplode("n_pairs").alias("_p", "n_pairs")).groupBy(*keys, "_s", "_d", "_p").agg(F.sum("n_pairs").alias("n_pairs"))
    named = each.join(listed.select(*keys, "_types"), [*keys]).select(*keys, F.get("_types", F.col("_s")).alias("src_type"), F.get("_types", F.col("_d")).alias("tgt_type"), "n_pairs")
    scored = named.join(seen.select(*keys, "src_type", "tgt_type", "n_src", "observed"), [*keys, "src_type", "tgt_type"])
    value = F.col("n_pairs") / F.col("n_src")
    sums = scored.groupBy(*keys, "src_type", "tgt_type").agg(F.sum(value).alias("_sum"), F.sum(value * value).alias("_sq"), F.sum((value >= F.col("observed")).cast("long")).alias("_ge"))
    # A group without any edge has no row: every permutation counts as 0, which reaches an observed 0.
    joined = seen.join(sums, [*keys, "src_type", "tgt_type"], "left")
    return joined.select(*keys, "src_type", "tgt_type", "observed", F.coalesce("_sum", F.lit(0.0)).alias("sum"), F.coalesce("_sq", F.lit(0.0)).alias("sum_sq"), F.coalesce("_ge", F.lit(n)).alias("n_ge"), F.lit(n).alias("n_perm"))


def interaction_scores(null: DataFrame) -> DataFrame:
    """Mean and population deviation of the null, z (0 without spread) and p = (exceedances + 1) / (n + 1), to 4 decimals."""
    mean = F.col("sum") / F.col("n_perm")
    std = F.sqrt(F.greatest(F.col("sum_sq") / F.col("n_perm") - mean * mean, F.lit(0.0)))
    z = F.when(std > 1e-12, (F.col("observed") - mean) / std).otherwise(0.0)
    p = (F.col("n_ge") + 1) / (F.col("n_perm") + 1)
    return null.select(*[c for c in null.columns if c not in ("sum", "sum_sq", "n_ge", "n_perm")], F.bround(mean, 4).alias("null_mean"), F.bround(std, 4).alias("null_std"), F.bround(z, 4).alias("z_score"), F.bround(p, 4).alias("p_value"))


def _falling(count: Column, k: int) -> Column:
    """count * (count - 1) * ... over ``k`` factors, in doubles; 0 where there are fewer than ``k``."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(count - i, F.lit(0)).cast("double")
    return out


def _chance(n: Column, *asked: tuple[Column, int]) -> Column:
    """Probability that ``sum(k)`` given places, dealt from ``n`` cells, bear types of the given counts, ``k`` places each."""
    top, places = F.lit(1.0), sum(k for _, k in asked)
    for count, k in asked:
        top = top * _falling(count, k)
    bottom = _falling(n, places)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def exact_null(cells: DataFrame, graph: DataFrame, keys: Sequence[str] = ("core",), item: str = "cell_id") -> DataFrame:
    """Exact mean and deviation of interactions over all permutations of types on a fixed graph; no permutation is drawn.

    ``graph(keys, src, dst)`` has distinct directed edges without loops. The square of a pair's count is a sum over ordered
    pairs of edges, and the chance of such a pair hangs on what its edges share: both ends in order, both ends reversed, a
    source, a target, a chain through one cell, or nothing. How many there are of each follows from the degrees, so the
    work is one count per cell. Each chance is taken less the squared mean chance, which keeps the variance of large
    graphs from cancelling out.
    """
    seen = observed_interactions(cells, graph, keys, item)
    two = graph.select(*keys, F.col("src").alias("_c"), F.lit(1).alias("_o"), F.lit(0).alias("_i")).unionByName(graph.select(*keys, F.col("dst").alias("_c"), F.lit(0).alias("_o"), F.lit(1).alias("_i")))
    degrees = two.groupBy(*keys, "_c").agg(F.sum("_o").cast("double").alias("_o"), F.sum("_i").cast("double").alias("_i"))
    shared = degrees.groupBy(*keys).agg(F.sum("_o").alias("_m"), F.sum(F.col("_o") * (F.col("_o") - 1)).alias("_fan_out"), F.sum(F.col("_i") * (F.col("_i") - 1)).alias("_fan_in"), F.sum(F.col("_o") * F.col("_i")).alias("_through"))
    ends = graph.groupBy(*keys, F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(F.count("*").alias("_k"))
    back = ends.filter("_k = 2").groupBy(*keys).agg((F.count("*") * 2).cast("double").alias("_back"))
    return _moments(cells, seen, shared.join(back, [*keys], "left"), keys)


def _moments(cells: DataFrame, seen: DataFrame, shared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores from the observed means and ``shared(keys, _m, _fan_out, _fan_in, _through, _back)``, as in ``exact_null``."""
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
    kinds = cells.groupBy(*keys, F.col("cell_type").alias("tgt_type")).agg(F.count("*").alias("_nt"))
    joined = seen.join(kinds, [*keys, "tgt_type"]).join(sizes, [*keys]).join(shared, [*keys], "left")
    joined = joined.fillna(0.0, ["_m", "_fan_out", "_fan_in", "_through", "_back"])
    n, s, t, m = F.col("_n"), F.col("n_src"), F.col("_nt"), F.col("_m")
    same = F.col("src_type") == F.col("tgt_type")
    pick = lambda alike, apart: F.when(same, alike).otherwise(apart)
    one = pick(_chance(n, (s, 2)), _chance(n, (s, 1), (t, 1)))
    three = _chance(n, (s, 3))
    chain = F.col("_through") - F.col("_back")
    apart = m * m - m - F.col("_back") - F.col("_fan_out") - F.col("_fan_in") - chain * 2
    terms = [
        (m, one),
        (F.col("_back"), pick(one, F.lit(0.0))),
        (F.col("_fan_out"), pick(three, _chance(n, (s, 1), (t, 2)))),
        (F.col("_fan_in"), pick(three, _chance(n, (s, 2), (t, 1)))),
        (chain * 2, pick(three, F.lit(0.0))),
        (apart, pick(_chance(n, (s, 4)), _chance(n, (s, 2), (t, 2)))),
    ]
    variance = sum((count * (chance - one * one) for count, chance in terms), F.lit(0.0))
    out = joined.withColumn("null_mean", m * one / s).withColumn("null_std", F.sqrt(F.greatest(variance, F.lit(0.0))) / s)
    z = F.when(F.col("null_std") > 1e-6, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).otherwise(0.0)
    return out.select(*keys, "src_type", "tgt_type", "observed", "null_mean", "null_std", z.alias("z_score"))


def _usable(cells: DataFrame, dims: Sequence[str], min_cells: int, keys: Sequence[str], item: str) -> DataFrame:
    """Cells of types with enough cells, in groups with two such types or more."""
    counts = cells.groupBy(*keys, "cell_type").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_cells)
    groups = counts.groupBy(*keys).agg(F.count("*").alias("_k")).filter("_k >= 2").select(*keys)
    return cut(cells.join(counts.drop("_n"), [*keys, "cell_type"], "left_semi").join(groups, [*keys], "left_semi").select(*keys, item, "cell_type", *dims))


def exact_interactions(cells: DataFrame, dims: Sequence[str], radius: float = 50.0, min_cells: int = 10, keys: Sequence[str] = ("core",), item: str = "cell_id") -> DataFrame:
    """As ``interactions``, with the exact mean and deviation in place of drawn permutations, and no p-value."""
    usable = _usable(cells, dims, min_cells, keys, item)
    counts, degrees = neighbour_totals(usable, radius, dims, keys, item)
    m, fan = F.col("n").cast("double"), F.col("fan").cast("double")
    # Every edge of such a graph has its reverse.
    shared = degrees.select(*keys, m.alias("_m"), fan.alias("_fan_out"), fan.alias("_fan_in"), (m + fan).alias("_through"), m.alias("_back"))
    return _moments(usable, _over_grid(usable, counts, keys), shared, keys)


def interactions(cells: DataFrame, dims: Sequence[str], radius: float = 50.0, n_perm: int = 1000, min_cells: int = 10, keys: Sequence[str] = ("core",), seed: int = 42, item: str = "cell_id") -> DataFrame:
    """Scores of every ordered pair of types with enough cells, in groups with two such types or more."""
    usable = _usable(cells, dims, min_cells, keys, item)
    return interaction_scores(permutation_null_within(usable, radius, dims, n_perm, seed, keys, item))


def interactions_2d(cells: DataFrame, dims: Sequence[str] = ("x_um", "y_um"), keys: Sequence[str] = ("core",), slice_key: str = "slice_id", **options) -> DataFrame:
    """Scores in each slice, then over slices: mean and deviation of z, mean observed, slices."""
    return over_slices(interactions(cells, dims, keys=[*keys, slice_key], **options), keys, slice_key)


def over_slices(per: DataFrame, keys: Sequence[str] = ("core",), slice_key: str = "slice_id") -> DataFrame:
    """Mean and deviation of z over slices, mean observed and the number of slices, for scores of one slice each."""
    return per.groupBy(*keys, "src_type", "tgt_type").agg(F.avg("z_score").alias("mean_z"), F.stddev_samp("z_score").alias("std_z"), F.avg("observed").alias("mean_observed"), F.countDistinct(slice_key).alias("n_slices"))


def proximity_to(scores: DataFrame, target: str, value: str = "z_score") -> DataFrame:
    """Scores of all types toward one."""
    return scores.filter(F.col("tgt_type") == target).drop("tgt_type")
