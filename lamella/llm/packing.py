"""Packing documents into fixed windows: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut, text_batches
from lamella.llm.tokens import encoded

PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``window``: full windows from the start, then the rest.

    Columns: doc_id, start, length, ids_crc32 (of the ids as little-endian 32-bit), doc_tokens; with ``ids`` also the
    token ids. Every document ends in ``end_id``, so a null or empty text is one piece of one token.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "start", "length", "crc", "total", "ids")}
            for at, packed in enumerate(encoded(tokenizer_path, ((t.as_py() or "") for t in batch.column(1)))):
                packed += last
                for start in range(0, len(packed), 4 * window):
                    part = packed[start : start + 4 * window]
                    for k, v in zip(rows, (at, start // 4, len(part) // 4, zlib.crc32(part), len(packed) // 4, part)):
                        rows[k].append(v)
            columns = [batch.column(0).take(pa.array(rows["at"], pa.int64()))]
            columns += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "total")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in rows["ids"]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text_batches(docs.sparkSession)
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<bigint>" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by an active set: columns enter by gradient, leave at zero."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax()) if len(gradient) else 0
        if not len(gradient) or gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            used = np.flatnonzero(passive)
            part = a[:, used]
            solved = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(used)), part.T @ b)
            if not len(used) or solved.min() > 0:
                break
            low = solved <= 0
            step = np.min(x[used][low] / np.maximum(x[used][low] - solved[low], 1e-300))
            x[used] += step * (solved - x[used])
            passive[used[x[used] <= 1e-12]] = False
            x[~passive] = 0
        x[:] = 0
        x[np.flatnonzero(passive)] = solved
    return x


def patterns(units: int, depth: int, present: np.ndarray, slack: int = 1) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` lengths (in units, only those present) whose sum fills ``units`` up to ``slack``."""
    sizes = [int(s) for s in np.flatnonzero(present)]
    found = [(s,) for s in sizes if units - slack <= s <= units]
    have = set(sizes)
    for k in range(2, depth + 1):
        for head in combinations_with_replacement(sizes, k - 1):
            rest = units - sum(head)
            found += [(*head, last) for last in range(max(head[-1], rest - slack), rest + 1) if last in have]
    return found


def plan(histogram: np.ndarray, units: int, depth: int = 3) -> list[tuple[tuple[int, ...], float]]:
    """Patterns with their repeats, for ``histogram[s]`` pieces of ``s`` units; the commonest patterns first."""
    total = float(histogram.sum())
    combos = patterns(units, depth, histogram > 0) if total else []
    if not combos:
        return []
    a = np.zeros((units + 1, len(combos)))
    for j, combo in enumerate(combos):
        for s in combo:
            a[s, j] += 1
    x = nnls(a, histogram / total) * total
    chosen = [(combos[j], float(x[j])) for j in np.flatnonzero(x > 1e-9)]
    return sorted(chosen, key=lambda c: (-c[1], c[0]))


def place(lengths: np.ndarray, window: int, unit: int, repeats: list[tuple[tuple[int, ...], float]], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length: rounded repeats of the patterns, then best fit, longest first."""
    sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    bins: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable"):
        bins.setdefault(-(-int(lengths[i]) // unit), []).append(int(i))
    free: list[int] = []

    def put(i: int, s: int) -> None:
        sequence[i], offset[i] = s, window - free[s]
        free[s] -= int(lengths[i])

    for combo, count in repeats:
        needed = {s: combo.count(s) for s in combo}
        times = min([round(count * share), *(len(bins.get(s, ())) // n for s, n in needed.items())])
        for _ in range(times):
            free.append(window)
            for s in combo:
                put(bins[s].pop(), len(free) - 1)
    at: dict[int, list[int]] = {}
    mask = 0
    for s, space in enumerate(free):
        at.setdefault(space, []).append(s)
        mask |= 1 << space
    for i in sorted((i for b in bins.values() for i in b), key=lambda i: (-lengths[i], i)):
        fits = mask >> int(lengths[i])
        if fits:
            space = (fits & -fits).bit_length() - 1 + int(lengths[i])
            s = at[space].pop()
            if not at[space]:
                mask ^= 1 << space
        else:
            free.append(window)
            s = len(free) - 1
        put(i, s)
        at.setdefault(free[s], []).append(s)
        mask |= 1 << free[s]
    return sequence, offset


def packed(cut_up: DataFrame, window: int = 4096, unit: int = 32, depth: int = 3, shard_rows: int = 8192) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut_up`` is read twice and should be stored.

    The histogram of piece lengths has ``window`` / ``unit`` bins whatever the input; the driver solves for repeats on it.
    Pieces are dealt by hash into shards of about ``shard_rows``; each shard rounds its share of the repeats and packs
    what is left by best fit. Rows that share an id are dealt by content, and rows equal in everything, by the thousand
    that they are in, as numbered within the stored partitions, so that no shard grows with one id. Stored partitions do
    not change, so a lost task gives the same sequences again.
    """
    units = window // unit
    bin_of = F.ceil(F.col("length") / unit)
    histogram = np.zeros(units + 1)
    for row in cut_up.groupBy(bin_of.alias("bin")).count().collect():  # at most window / unit rows
        histogram[row["bin"]] = row["count"]
    total = int(histogram.sum())
    shards = max(1, round(total / shard_rows))
    repeats = plan(histogram, units, depth)

    def pack_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = place(frame["length"].to_numpy(), window, unit, repeats, len(frame) / total)
        return frame.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    kind = cut_up.schema["doc_id"].dataType.simpleString()
    salt = F.shiftright(F.monotonically_increasing_id(), 10)
    dealt = cut_up.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", salt), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack_shard, PIECES.format(id=kind) + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096) -> DataFrame:
    """All ``docs(doc_id, text)`` packed into sequences of at most ``window`` tokens, one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is its end token.
    Repeated rows are packed as often as they occur; a null doc_id is packed too; a very long text spans windows. Columns
    other than doc_id and text are ignored. An empty table gives an empty result. ``pieces(..., ids=True)`` gives the ids.
    """
    return packed(cut(pieces(docs, tokenizer_path, window)), window)
