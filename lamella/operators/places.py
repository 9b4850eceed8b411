"""Neighbours of crowded cells: counted by rows of places, not by pairs of cells.

Where many cells share rows and columns, a place's neighbours within a radius are one run of places in each row near it, and
the run's cells are a difference of two running counts. Work follows the places and the rows near them, however many cells
stand at each. Distances are compared as everywhere else, so counts are the same to the last pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Tile:
    """The places of a tile and of what lies around it: columns of the first dimension, rows of all others."""

    shape: tuple[int, int]
    columns: slice
    rows: np.ndarray
    at: np.ndarray
    #: Rows of one layer and a run in them, first and last (excluded) column for each own column, and where it is added.
    steps: list[tuple[int, int, slice | np.ndarray, slice | np.ndarray, list[tuple[int, int, int, int]]]] = field(default_factory=list)


def _consecutive(run: np.ndarray) -> slice | np.ndarray:
    return slice(int(run[0]), int(run[0]) + len(run)) if run[0] + len(run) - 1 == run[-1] and (np.diff(run) == 1).all() else run


def tile(own: np.ndarray, coords: Sequence[np.ndarray], most: float, half: bool) -> Tile:
    """Where the runs within a squared distance of ``most`` lie; with ``half`` each pair of different places is met from one of them.

    Own cells fill whole columns and rows of their part, as they do if they are all cells of a box.
    """
    xs, ix = np.unique(coords[0], return_inverse=True)
    codes, values = np.zeros(len(own), dtype=np.int64), []
    for c in reversed(coords[1:]):
        v, i = np.unique(c, return_inverse=True)
        codes = codes * len(v) + i
        values.insert(0, v)
    known, ir = np.unique(codes, return_inverse=True)
    held = []
    rest = known
    for v in values:
        held.append(v[rest % len(v)])
        rest = rest // len(v)
    layer = known // (len(values[0]) if values else 1)
    first, last = ix[own].min(), ix[own].max() + 1
    rows = np.unique(ir[own])
    found = Tile((len(xs), len(known)), slice(int(first), int(last)), rows, ix * len(known) + ir)
    across = (xs[first:last, None] - xs) ** 2
    squares = [(h[rows][:, None] - h) ** 2 for h in held] or [np.zeros((1, 1))]
    least = np.zeros(squares[0].shape)
    for s in squares:
        least = least + s
    close = least <= most
    if half:
        close &= np.arange(len(known)) >= rows[:, None]
    i, j = np.nonzero(close)
    kinds, which = np.zeros(len(i), dtype=np.int64), []
    for s in squares:
        v, k = np.unique(s[i, j], return_inverse=True)
        kinds = kinds * len(v) + k
        which.append(v)
    same = rows[i] == j
    kinds = kinds * 2 + (same if half else 0)
    kinds, of = np.unique(kinds, return_inverse=True)
    runs: dict[bytes, int] = {}
    bounds, number = [], np.empty(len(kinds), dtype=np.int64)
    for n, kind in enumerate(kinds):
        kind, own_row = divmod(int(kind), 2)
        total, parts = across, []
        for v in reversed(which):
            kind, k = divmod(kind, len(v))
            parts.insert(0, v[k])
        for p in parts:
            total = total + p
        near = total <= most
        low = near.argmax(axis=1)
        high = low + near.sum(axis=1)
        if own_row:
            low = np.arange(first, last) + 1
        number[n] = runs.setdefault(low.tobytes() + high.tobytes(), len(bounds))
        if number[n] == len(bounds):
            bounds.append((_consecutive(low), _consecutive(high)))
    number = number[of]
    order = np.lexsort((i, j - i, number, layer[j]))
    i, j, number, at = i[order], j[order], number[order], layer[j[order]]
    group = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(at) != 0)])
    for a, b in zip(group, [*group[1:], len(i)]):
        cuts = np.r_[a, a + 1 + np.flatnonzero((np.diff(i[a:b]) != 1) | (np.diff(j[a:b]) != 1)), b]
        parts = [(int(i[p]), int(i[q - 1]) + 1, int(j[p]), int(j[q - 1]) + 1) for p, q in zip(cuts[:-1], cuts[1:])]
        found.steps.append((int(j[a:b].min()), int(j[a:b].max()) + 1, *bounds[number[a]], parts))
    return found


def around(at: Tile, counts: np.ndarray) -> np.ndarray:
    """Sums of ``counts(column, row, ...)`` over the runs of every own place, in the type of ``counts``."""
    running = np.empty((at.shape[0] + 1, *counts.shape[1:]), dtype=counts.dtype)
    running[0] = 0
    for x in range(at.shape[0]):
        np.add(running[x], counts[x], out=running[x + 1])
    total = np.zeros((at.columns.stop - at.columns.start, len(at.rows), *counts.shape[2:]), dtype=counts.dtype)
    for low_row, high_row, low, high, parts in at.steps:
        if len(parts) > 1 or not isinstance(low, slice) or not isinstance(high, slice):
            some = running[:, low_row:high_row]
            inside = some[high] - some[low]
            for i0, i1, j0, j1 in parts:
                part = total[:, i0:i1]
                np.add(part, inside[:, j0 - low_row : j1 - low_row], out=part)
        else:
            i0, i1, j0, j1 = parts[0]
            part = total[:, i0:i1]
            np.add(part, running[high, j0:j1], out=part)
            np.subtract(part, running[low, j0:j1], out=part)
    return total


def tallied(own: np.ndarray, coords: Sequence[np.ndarray], kinds: np.ndarray, counts: np.ndarray, width: int, most: float) -> tuple[np.ndarray, int, int]:
    """Pairs by type of each end, pairs in all and the sum of d * (d - 1) over the cells' numbers d of neighbours.

    ``counts`` cells of type ``kinds`` stand at each place of ``coords``; own cells are sources.
    """
    at = tile(own, coords, most, False)
    placed = np.zeros((at.shape[0] * at.shape[1], width), dtype=np.int64)
    np.add.at(placed, (at.at, kinds), counts)
    placed = placed.reshape(*at.shape, width)
    near = around(at, placed).reshape(-1, width)
    mine = placed[at.columns][:, at.rows].reshape(-1, width)
    pairs = mine.T @ near - np.diag(mine.sum(axis=0))
    many, degree = mine.sum(axis=1), near.sum(axis=1) - 1
    return pairs, int((many * degree).sum()), int((many * degree * (degree - 1))[many > 0].sum())


class Drawn:
    """Pairs by type of each end in one tile, for cells that are given numbers again and again.

    A number tells a cell's type by ``bounds``, the running counts of types. Per place and bound the cells whose numbers reach it
    are counted; counts of types are differences of these. They are held modulo 2^16 where no sum can exceed it.
    """

    def __init__(self, own: np.ndarray, coords: Sequence[np.ndarray], bounds: np.ndarray, most: float):
        self.tile = at = tile(own, coords, most, True)
        size, self.bounds = at.shape[0] * at.shape[1], bounds
        many = np.bincount(at.at, minlength=size)
        self.many = many.reshape(at.shape)[at.columns][:, at.rows].ravel()
        near = around(at, many.reshape(*at.shape, 1).astype(np.int64)).ravel()
        self.occupied = np.flatnonzero(self.many)
        self.many, self.near = self.many[self.occupied].astype(np.float64), (2 * near + self.many)[self.occupied].astype(np.float64)
        self.kind = np.uint16 if self.near.max() < 2**16 else np.uint32 if self.near.max() < 2**32 else np.uint64
        # Cells in layers, so that no place is twice in one.
        self.order = np.argsort(at.at, kind="stable")
        places = at.at[self.order]
        begins = np.flatnonzero(np.r_[True, np.diff(places) != 0])
        nth = np.arange(len(places)) - np.repeat(begins, np.diff(np.r_[begins, len(places)]))
        deal = np.argsort(nth, kind="stable")
        self.order, self.places = self.order[deal], places[deal]
        self.layers = np.r_[0, np.cumsum(np.bincount(nth))]

    def at_once(self) -> int:
        """So many numberings keep the counts of own places in a core's memory."""
        own = (self.tile.columns.stop - self.tile.columns.start) * len(self.tile.rows) * max(1, len(self.bounds) - 1)
        return int(min(64, max(8, 700_000 // own)))

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Ordered pairs, (numbering, type, type), for ``numbers(cell, numbering)`` with the cells in ``order``."""
        at, many, width = self.tile, numbers.shape[1], len(self.bounds)
        reach = np.empty((len(numbers), width - 1, many), dtype=self.kind)
        for t, b in enumerate(self.bounds[:-1]):
            np.greater_equal(numbers, numbers.dtype.type(b), out=reach[:, t], casting="unsafe")
        reach = reach.reshape(len(numbers), (width - 1) * many)
        counts = np.zeros((at.shape[0] * at.shape[1], reach.shape[1]), dtype=self.kind)
        counts[self.places[: self.layers[1]]] = reach[: self.layers[1]]
        for a, b in zip(self.layers[1:-1], self.layers[2:]):
            counts[self.places[a:b]] += reach[a:b]
        counts = counts.reshape(*at.shape, (width - 1) * many)
        near = around(at, counts)
        mine = counts[at.columns][:, at.rows]
        near += near
        near += mine
        tall = []
        for known, drawn in ((self.many, mine), (self.near, near)):
            both = np.empty((many, width, len(self.occupied)))
            both[:, 0] = known
            both[:, 1:] = drawn.reshape(drawn.shape[0] * drawn.shape[1], width - 1, many)[self.occupied].transpose(2, 1, 0)
            tall.append(both)
        met = np.matmul(tall[0], tall[1].transpose(0, 2, 1))
        own = tall[0].sum(axis=2)
        for axis in (1, 2):
            met = -np.diff(met, axis=axis, append=0.0)
        own = -np.diff(own, axis=1, append=0.0)
        met = (met + met.transpose(0, 2, 1)) / 2
        met[:, np.arange(width), np.arange(width)] -= own
        return met.astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each combination of ``keys``, which arrive one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            c = batch.column(k)
            changed |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
