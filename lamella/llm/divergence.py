"""Source divergence audit: term counts of sources, held as bitsets of terms per count, compared source by source."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import LOWER, UPPER, broadcast_if_small, cut, sliced, stored, text_batches

#: Words of 64 bits in a bitset.
WORDS = 4
#: Counts of a source's term that a Python task holds before it passes them on, of 24 bytes each.
HELD = 1_500_000
#: Bitset chunks compared in one group, and sources in a block, on average.
CHUNKS, SOURCES = 16, 24
#: So many rows of small tables (sources, languages, chunk sizes) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000
#: So many kept terms are broadcast to what tasks have counted; more are joined by shuffle.
BROADCAST_TERMS = 300_000

#: Bytes of UTF-8: letters stay, A-Z lower-cased, other ASCII becomes a blank, all the rest belongs to terms.
_BYTES = bytes(b if b >= 128 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))


def _numbers() -> defaultdict:
    """Numbers for keys, from 0, in the order in which they are first asked for."""
    return defaultdict(count().__next__)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, n, n_docs, counts)`` with ``counts`` an array of ``(source, n)``: a row for each term of a language and task.

    Terms of ``docs(lang, source, text)`` are numbered within a task and counted as sorted numbers; what a task has found is
    passed on at its end, or when it holds ``HELD`` counts of a source's term.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, langs, sources = (_numbers() for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            # A cell is a term, a language and a source; its bits sort in that order.
            cells, n, n_docs = found.pop()
            rows = np.flatnonzero(np.diff(cells >> 20, prepend=-1)).astype(np.int32)
            texts, names, spoken = pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(sources), pa.string()), pa.array(list(langs), pa.string())
            for at in range(0, len(rows), 20_000):
                starts = np.append(rows[at : at + 20_000], rows[at + 20_000] if at + 20_000 < len(rows) else len(cells))
                part = slice(starts[0], starts[-1])
                offsets = starts - starts[0]
                counts = pa.StructArray.from_arrays([names.take(pa.array(cells[part] & 0xFFFFF)), pa.array(n[part])], names=["source", "n"])
                first = cells[starts[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [spoken.take(pa.array(first >> 20 & 0xFFF)), texts.take(pa.array(first >> 32)), pa.array(np.add.reduceat(n[part], offsets[:-1])), pa.array(np.add.reduceat(n_docs[part], offsets[:-1])), pa.ListArray.from_arrays(offsets, counts)],
                    names=["lang", "term", "n", "n_docs", "counts"],
                )

        for batch in sliced(batches, 200):
            if len(langs) > 0xE00 or len(sources) > 0xFF000:  # numbers of 12 and 20 bits
                found[:] = _summed(found)
                yield from flushed()
                terms, langs, sources = (_numbers() for _ in range(3))
            words = [t.as_py().translate(_BYTES).split() for t in batch.column("text").cast(pa.large_binary())]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            of = np.fromiter((langs[a] << 20 | sources[b] for a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())), np.int64, len(words))
            own = np.fromiter(map(terms.__getitem__, chain.from_iterable(words)), np.int64, lengths.sum())
            once, times = np.unique(own << 32 | np.repeat(np.arange(len(words)), lengths), return_counts=True)
            found.append((once >> 32 << 32 | of[once & 0xFFFFFFFF], times, np.ones(len(once), dtype=np.int64)))
            if sum(len(f[0]) for f in found) > 2 * HELD:
                found[:] = _summed(found)
                if len(found[0][0]) > HELD:
                    yield from flushed()
                    terms, langs, sources = (_numbers() for _ in range(3))
        if sum(len(f[0]) for f in found):
            found[:] = _summed(found)
            yield from flushed()

    return docs.select("lang", "source", "text").mapInArrow(emit, "lang string, term string, n long, n_docs long, counts array<struct<source:string,n:long>>")


def _summed(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Sorted cells without repeats, the numbers beside them added up."""
    cells, *numbers = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(cells)
    cells = cells[order]
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    return [(cells[starts], *(np.add.reduceat(x[order], starts) for x in numbers))]


def share(times: Column | int, total: Column, kept: Column) -> Column:
    """Smoothed share of a term in whole billionths, plus one: ``1 + floor(10^9 (times + 5) / (total + 5 kept))``, in exact arithmetic."""
    times = times if isinstance(times, Column) else F.lit(times)
    above = (times + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", above, (total + 5 * kept).cast("decimal(19,0)"))


def _bits(place: Column) -> list[Column]:
    """The bitset of a group's places, ``WORDS`` words."""
    return [F.bit_or(F.when(F.floor(place / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]


def _placed(lexicon: DataFrame) -> DataFrame:
    """``lexicon(lang, term, total)`` with ``chunk`` and ``place``, a bit of its bitset.

    Terms of about equal frequency share a chunk, by hash, so that a source has few different counts in it: rare terms
    three or four, and only the few chunks of frequent terms about as many as terms.
    """
    band = F.floor(F.log2("total")).cast("int")
    banded = lexicon.withColumn("band", band)
    sizes = broadcast_if_small(cut(banded.groupBy("lang", "band").agg(F.count("*").alias("size"))), BROADCAST_ROWS)
    dealt = banded.join(sizes, ["lang", "band"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.ceil(F.col("size") / (WORDS * 48))))
    ordinal = F.row_number().over(Window.partitionBy("lang", "band", "bucket").orderBy("term")) - 1
    # A bucket that hashing made fuller than a bitset goes on in another chunk.
    numbered = dealt.withColumn("_n", ordinal).withColumn("place", (F.col("_n") % (WORDS * 64)).cast("int"))
    return numbered.withColumn("chunk", F.xxhash64("band", "bucket", F.floor(F.col("_n") / (WORDS * 64)))).select("lang", "term", "total", "chunk", "place")


def _compared(table: pa.Table) -> pa.Table:
    """``(source, item, value)`` for the pairs of sources of a group: absolute differences of shares, summed over its chunks' terms.

    Rows of a group: the mask of each chunk (no source), the share that a count of zero has for each source (no chunk),
    and bitsets of terms per (source, chunk, share).
    """
    rows = {c: table.column(c).to_pylist() for c in ("lang", "source")}
    block, side, chunk, share_ = (table.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("block", "lo", "chunk", "p"))
    hi = table.column("hi")[0].as_py()
    words = np.stack([table.column(f"w{w}").combine_chunks().fill_null(0).to_numpy() for w in range(WORDS)], axis=1).view(np.uint64)
    kind = table.column("kind").to_numpy()
    sources = sorted({(int(block[i]), rows["source"][i]) for i in np.flatnonzero(kind == 1)})
    zero = {(int(block[i]), rows["source"][i]): int(share_[i]) for i in np.flatnonzero(kind == 1)}
    sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
    of: dict[int, list[int]] = {}
    for i in np.flatnonzero(kind == 2):
        of.setdefault(int(chunk[i]), []).append(i)
    for mask in np.flatnonzero(kind == 0):
        levels: dict[tuple[int, str], list[int]] = {}
        for i in of.get(int(chunk[mask]), ()):
            levels.setdefault((int(block[i]), rows["source"][i]), []).append(i)
        shares, bits, starts = [], [], [0]
        for source in sources:
            own = levels.get(source, [])
            there = np.bitwise_or.reduce(words[own], axis=0) if own else np.zeros(WORDS, dtype=np.uint64)
            shares.append(np.append(share_[own], zero[source]))
            bits.append(np.vstack([words[own], words[mask] & ~there]))
            starts.append(starts[-1] + len(own) + 1)
        if not sources:
            continue
        all_shares, all_bits = np.concatenate(shares), np.vstack(bits)
        for s in range(len(sources) - 1):
            rest = slice(starts[s + 1], None)
            both = np.bitwise_count(bits[s][:, None, :] & all_bits[None, rest, :]).sum(axis=2, dtype=np.int64)
            apart = (both * np.abs(shares[s][:, None] - all_shares[rest])).sum(axis=0)
            sums[s, s + 1 :] += np.add.reduceat(apart, np.array(starts[s + 1 : -1]) - starts[s + 1])
    lo, lang = int(side[0]), rows["lang"][0]
    found = [(lang, a[1], b[1], int(sums[i, j])) for i, a in enumerate(sources) for j, b in enumerate(sources) if i < j and (a[0], b[0]) == (lo, hi)]
    columns = list(zip(*found)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("lang", "source", "item", "value"), columns, (pa.string(), pa.string(), pa.string(), pa.int64()))})


def divergence(docs: DataFrame, least_docs: int = 30, terms: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language lies from the others, and by which terms.

    Terms are maximal runs of letters and of anything beyond ASCII, A-Z lower-cased; a language keeps the terms that
    ``least_docs`` of its documents have. Part ``pair`` sums the differences of shares over all kept terms for every two sources
    of a language; part ``term`` lists the ``terms`` kept terms by which a source most exceeds its language. Ranks go by value,
    descending, then by item.

    For the pairs, the terms that have one count in a source are a bitset. Of two sources the AND of two bitsets,
    counted, is the number of terms with those two counts; terms without a count are the complement of a source's bitsets.
    Blocks of sources meet for a few chunks of terms at a time, so no task holds a language.

    A null text, lang or source is an empty one. A source without terms takes part with counts of zero; a language that keeps no term
    has pairs of value 0. Repeated rows are documents of their own. An empty table gives an empty result; other columns are
    ignored.
    """
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    text_batches(docs.sparkSession)
    counted = stored(term_counts(texts), "divergence-counts")
    groups = cut(texts.groupBy("lang", "source").agg(F.count("*").alias("n")).drop("n"))
    lexicon = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_docs).drop("n_docs")
    lexicon = stored(lexicon, "divergence-lexicon")
    kept = cut(lexicon.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang")))
    placed = stored(_placed(lexicon), "divergence-placed")
    places = broadcast_if_small(placed, BROADCAST_TERMS)
    cells = counted.join(places.select("lang", "term", "chunk", "place"), ["lang", "term"]).select("lang", "chunk", "place", F.explode("counts").alias("c"))
    cells = stored(cells.groupBy("lang", F.col("c.source").alias("source"), "chunk", "place").agg(F.sum("c.n").alias("n")), "divergence-cells")
    found = cells.join(places, ["lang", "chunk", "place"])
    sums = cut(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_source")))
    sized = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n_source", "kept", "n_lang"])
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
    # With no kept term a share has nothing to divide by; no term then asks for it.
    sized = sized.join(per_lang, "lang").withColumn("kept", F.greatest("kept", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    sized = stored(sized, "divergence-sources")
    few = broadcast_if_small(sized, BROADCAST_ROWS)
    shared = found.join(few, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_source"), F.col("kept"))).withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("kept")))

    levels = stored(shared.groupBy("lang", "source", "block", "blocks", "chunk", "p").agg(*_bits(F.col("place"))), "divergence-bitsets")
    masks = stored(placed.groupBy("lang", "chunk").agg(*_bits(F.col("place"))), "divergence-masks")
    bundles = cut(masks.groupBy("lang").agg(F.ceil(F.count("*") / CHUNKS).cast("int").alias("bundles")))
    langs = broadcast_if_small(stored(per_lang.join(bundles, "lang", "left").na.fill(1, ["bundles"]), "divergence-langs"), BROADCAST_ROWS)
    words = [f"w{w}" for w in range(WORDS)]
    none = [F.lit(None).cast("long").alias(w) for w in words]
    shape = ["lang", "bundle", "lo", "hi", "kind", "block", "source", "chunk", "p", *words]
    bundle = F.pmod(F.xxhash64("chunk"), "bundles").cast("int").alias("bundle")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ends = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    mask = masks.join(langs, "lang").select("*", bundle, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lo"))
    mask = mask.withColumn("hi", F.explode(F.sequence(F.col("lo"), F.col("blocks") - 1))).select(*shape[:4], F.lit(0).alias("kind"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("source"), "chunk", F.lit(None).cast("long").alias("p"), *words)
    zero = sized.join(langs.select("lang", "bundles"), "lang").select("*", other).select("*", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)).alias("bundle"))
    zero = zero.select("lang", "bundle", *ends, F.lit(1).alias("kind"), "block", "source", F.lit(None).cast("long").alias("chunk"), share(0, F.col("n_source"), F.col("kept")).alias("p"), *none)
    level = levels.join(langs.select("lang", "bundles"), "lang").select("*", bundle, other).select("lang", "bundle", *ends, F.lit(2).alias("kind"), "block", "source", "chunk", "p", *words)
    halves = mask.unionByName(zero).unionByName(level).groupBy("lang", "bundle", "lo", "hi").applyInArrow(_compared, "lang string, source string, item string, value long")
    halves = cut(halves.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    most = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    most = most.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    return pairs.unionByName(most)
