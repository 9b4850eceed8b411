"""Hard-negative mining: exact integer scores of anchor and candidate tiles by Strassen's scheme, merged into short heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import sliced, stored

#: Rows of a tile.
TILE = 1024
#: Candidate tiles that meet an anchor tile in one group, on average.
TOGETHER = 4
#: A product with a side of at most so many is not split further.
LEAF = 32

_TILES = "tile long, rows int, width int, ids binary, labels binary, values binary"
_FOUND = "tile long, at int, place int, anchor_id long, positive_id long, positive_score long, id long, score long"


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two small int64 matrices; in doubles where every partial sum is proven to be a whole number below 2^53."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    return np.pad(a, [(0, n % 2) for n in a.shape]) if any(n % 2 for n in a.shape) else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-sized products, odd sides padded with zeros.

    Additions wrap around, a ring in which the scheme is exact: the result is right wherever it fits in 64 bits itself.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return _plain(a, b)
    a, b = _even(a), _even(b)
    (a11, a12), (a21, a22) = (np.hsplit(half, 2) for half in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(half, 2) for half in np.vsplit(b, 2))
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])[:rows, :columns]


def packed(rows: DataFrame, tile: int) -> DataFrame:
    """``rows(id, label, values)`` as tiles of at most ``tile`` rows, cut from the partitions as they are; short vectors are padded with zeros."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in _full(batches, tile):
            values = batch.column("values")
            lengths = values.value_lengths().to_numpy()
            width = int(lengths.max(initial=0))
            matrix = np.zeros((batch.num_rows, width), dtype=np.int64)
            matrix[np.arange(width) < lengths[:, None]] = values.flatten().to_numpy()
            parts = [batch.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "label")] + [matrix.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([batch.num_rows], pa.int32()), pa.array([width], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=["tile", "rows", "width", "ids", "labels", "values"])
            number += 1

    return rows.select("id", "label", "values").mapInArrow(emit, _TILES)


def _full(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``rows`` rows but for the last one."""
    held: list[pa.RecordBatch] = []
    for batch in sliced(batches, rows):
        held.append(batch)
        while sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.slice(0, rows).to_batches()[0]
            held = table.slice(rows).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Tile:
    """A tile as it comes out of a table of tiles."""

    def __init__(self, table: pa.Table, row: int):
        value = {c: table.column(c)[row].as_py() for c in table.column_names}
        self.number, self.windows = value["tile"], value.get("windows")
        self.ids, self.labels = (np.frombuffer(value[c], "<i8") for c in ("ids", "labels"))
        self.values = np.frombuffer(value["values"], "<i8").reshape(value["rows"], value["width"])

    def scores(self, other: _Tile) -> np.ndarray:
        width = max(self.values.shape[1], other.values.shape[1])
        a, b = (np.pad(t.values, [(0, 0), (0, width - t.values.shape[1])]) for t in (self, other))
        if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) >= 2**63 and (np.abs(a.astype(float) @ b.T.astype(float)) >= 2**63).any():
            raise OverflowError("a score does not fit in 64 bits")
        return strassen(a, np.ascontiguousarray(b.T))


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id, in order."""
    near = np.arange(len(scores))
    if len(scores) > most:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return near[np.lexsort((ids[near], -scores[near]))[:most]]


def _positives(anchor: _Tile, other: _Tile, most: int) -> Iterator[tuple]:
    scores = anchor.scores(other)
    for at in range(len(anchor.ids)):
        near = np.flatnonzero((other.labels == anchor.labels[at]) & (other.ids != anchor.ids[at]))
        for x in near[_best(scores[at, near], other.ids[near], most)]:
            yield anchor.number, at, 0, int(anchor.ids[at]), None, None, int(other.ids[x]), int(scores[at, x])


def _within(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest whole s with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _negatives(anchor: _Tile, other: _Tile, most: int, low: int, high: int) -> Iterator[tuple]:
    scores = anchor.scores(other)
    bounds = [_within(w["score"], low, high) for w in anchor.windows]
    least, greatest = np.full(len(anchor.ids), 1), np.full(len(anchor.ids), 0)
    for w, (lo, hi) in zip(anchor.windows, bounds):
        if lo <= hi:
            least[w["at"]], greatest[w["at"]] = (min(least[w["at"]], lo), max(greatest[w["at"]], hi)) if least[w["at"]] <= greatest[w["at"]] else (lo, hi)
    fit = (scores >= least[:, None]) & (scores <= greatest[:, None]) & (other.labels != anchor.labels[:, None])
    for w, (lo, hi) in zip(anchor.windows, bounds):
        near = np.flatnonzero(fit[w["at"]])
        own = scores[w["at"], near]
        near = near[(own >= lo) & (own <= hi)]
        for x in near[_best(scores[w["at"], near], other.ids[near], most)]:
            yield anchor.number, w["at"], w["place"], int(anchor.ids[w["at"]]), w["id"], w["score"], int(other.ids[x]), int(scores[w["at"], x])


def _meet(anchors: DataFrame, candidates: DataFrame, dealt: tuple[int, int], find) -> DataFrame:
    """What ``find(anchor tile, candidate tile)`` yields for every two tiles: they meet in groups of a few tiles of either side."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = pa.schema([(n, pa.int32() if n in ("at", "place") else pa.int64()) for n in names])

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        ours = [_Tile(left, i) for i in range(left.num_rows)]
        rows = [row for j in range(right.num_rows) for other in [_Tile(right, j)] for anchor in ours for row in find(anchor, other)]
        return pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=kinds)

    own = [F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int") for n in dealt]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in dealt]
    left = anchors.withColumn("a", own[0]).withColumn("c", every[1])
    right = candidates.withColumn("c", own[1]).withColumn("a", every[0])
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(group, _FOUND)


def _top(found: DataFrame, most: int) -> DataFrame:
    """Heaps merged: the best ``most`` rows of each anchor and place, numbered from 1. Spark keeps as many of each task before the shuffle."""
    order = Window.partitionBy("tile", "at", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the anchors, rows whose id ``every`` divides.

    Components become ``floor(scale * x)`` and a score is an exact integer inner product; higher scores come first, ties
    by smaller id. An anchor's positives are its first ``positives`` rows of its label with another id; for each of them the first
    ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive`` come back.

    Anchors and candidates are packed into tiles. Every anchor tile meets every candidate tile twice: first for the
    positives, then, when their scores and so the windows are known, for the negatives. A meeting keeps a heap per anchor
    or window, and heaps are merged by ranks; scores are never rows.

    A null id, label or vector, or a null or non-finite component: the row takes no part. An empty vector is a zero vector;
    shorter vectors are padded with zeros. Repeated rows each take part, as anchors too. Labels are whole numbers. A score
    that does not fit in 64 bits ends the job with an error. An empty table, or one without anchors, gives an empty
    result; other columns are ignored.
    """
    x = F.col("vector")
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector")).where(F.coalesce(fit, F.lit(False)))
    rows = rows.select("id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("values"))
    asking = rows.where(F.col("id") % every == 0)
    candidates = stored(packed(rows, tile), "negatives-candidates")
    anchors = stored(packed(asking.repartition(max(1, -(-asking.count() // tile))), tile), "negatives-anchors")
    dealt = max(1, anchors.count()), max(1, -(-candidates.count() // TOGETHER))

    best = _top(_meet(anchors, candidates, dealt, lambda a, c: _positives(a, c, positives)), positives)
    # At most ``tile * positives`` entries a list.
    windows = stored(best.groupBy("tile").agg(F.collect_list(F.struct("at", F.col("rank").alias("place"), "id", "score")).alias("windows")), "negatives-windows")
    seeking = stored(anchors.join(windows, "tile"), "negatives-seeking")
    found = _top(_meet(seeking, candidates, dealt, lambda a, c: _negatives(a, c, negatives, low, high)), negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` with the label of each row whose ``vec_id`` ``every`` divides moved to the next of ``labels`` labels."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
