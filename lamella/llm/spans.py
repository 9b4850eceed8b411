"""Substring dedup by sliding sentence spans: sentences covered by a non-first repeated span go."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.common import sliced, stored, text_batches

#: A sentence ends after closing punctuation before white space, after full-width punctuation, or at a line end.
END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)\s*|[。！？]+[\"'”’)\]」』）]*\s*|\n\s*")
#: A span is at least so many sentences and words; a sentence longer than LONGEST words counts as several.
SENTENCES, WORDS, LONGEST = 2, 16, 14
#: A long sentence is cut after each word whose checksum this divides: equal passages are cut alike wherever they start.
CUT = 10
#: Bits of the filter of half hashes that are seen twice: 16 MB, however many spans there are.
BITS = 1 << 27
#: Thai, Lao, Burmese, Khmer, kana and Han have no blanks between words: each of their letters counts as a word.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
_UNSPACED, _WORD, _MIXED = re.compile(UNSPACED), re.compile(r"\S+"), re.compile(rf"{UNSPACED}|(?:(?!{UNSPACED})\S)+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of the sentences, covering the text without gaps."""
    out, start, spaced = [], 0, not _UNSPACED.search(text)
    word = _WORD if spaced else _MIXED
    split = (lambda t: t.lower().split()) if spaced else (lambda t: word.findall(t.lower()))
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        if end == start:
            continue
        words = split(text[start:end])
        if len(words) <= LONGEST:
            out.append((start, end, words))
        else:
            marks = list(word.finditer(text, start, end))
            cuts = [start, *(b.start() for a, b in zip(marks, marks[1:]) if zlib.crc32(a.group().lower().encode("utf-8", "surrogatepass")) % CUT == 0), end]
            out += [(a, b, split(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        start = end
    return out


def runs(parts: list[tuple[int, int, list[str]]]) -> list[tuple[int, int]]:
    """(first, past) for every start: the shortest run of sentences from there with enough sentences and words."""
    sizes = [len(w) for _, _, w in parts]
    out, end, held = [], 0, 0
    for first in range(len(parts)):
        while end < len(parts) and (held < WORDS or end - first < SENTENCES):
            held += sizes[end]
            end += 1
        if held < WORDS or end - first < SENTENCES:
            break
        out.append((first, end))
        held -= sizes[first]
    return out


def runs_to(parts: list[tuple[int, int, list[str]]]) -> list[tuple[int, int]]:
    """(first, past) for every end: the shortest run of sentences up to there with enough sentences and words."""
    n = len(parts)
    return [(n - past, n - first) for first, past in runs(parts[::-1])]


def span_hashes(docs: DataFrame, tails: bool = True) -> DataFrame:
    """(doc_id, text_key, first, past, h1, h2) for every span of every text; with ``tails`` also those of every end."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            at, first, past, h1, h2 = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                parts = sentences(text)
                joined = [" ".join(w) for _, _, w in parts]
                for a, b in sorted({*runs(parts), *runs_to(parts)}) if tails else runs(parts):
                    whole = xxhash.xxh3_128_intdigest(" ".join(joined[a:b]).encode("utf-8", "surrogatepass"))
                    at.append(i), first.append(a), past.append(b)
                    h1.append((whole >> 64) - (1 << 63)), h2.append((whole & ((1 << 64) - 1)) - (1 << 63))
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(past, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "first", "past", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(emit, f"doc_id {kind}, text_key bigint, first int, past int, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame, tails: bool = True) -> DataFrame:
    """(doc_id, text_key, first, past): the non-first occurrences, by (doc_id, place), of spans that occur repeatedly.

    Half hashes are counted first, so that only spans that may repeat are grouped by their whole hash; a filter of fixed
    size keeps most of the others out of that join's shuffle. Aggregates are stored before they are joined: both sides are
    dealt anew and a span of a third of all documents can be split.
    """
    every = stored(span_hashes(docs, tails), "spans")
    twice = stored(every.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "span-halves")
    some = stored(_sifted(every, twice).join(twice, "h1", "left_semi"), "span-candidates")
    groups = some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first", "text_key")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = some.join(stored(groups, "span-groups"), ["h1", "h2"])
    return met.where("NOT (struct(doc_id, first, text_key) <=> kept)").select("doc_id", "text_key", "first", "past")


def _sifted(every: DataFrame, twice: DataFrame, bits: int = BITS) -> DataFrame:
    """``every`` without most of the rows whose ``h1`` is not in ``twice``: a bit is set for each one that is.

    The bits are gathered by word, ``bits / 64`` rows at most, and broadcast.
    """
    place = F.pmod("h1", F.lit(bits))
    words = twice.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    known = np.zeros(bits // 64, dtype=np.uint64)
    known[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = every.sparkSession.sparkContext.broadcast(known)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("h1").to_numpy() % bits
            yield batch.filter(pa.array((held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return every.mapInArrow(sift, every.schema)


def drop_sentences(text: str, covered: list[int]) -> tuple[str, int]:
    """``text`` without the sentences numbered in ``covered``, and how many they are."""
    gone = set(covered)
    return "".join(text[a:b] for i, (a, b, _) in enumerate(sentences(text)) if i not in gone), len(gone)


def without_repeated_spans(docs: DataFrame, tails: bool = True) -> DataFrame:
    """``docs`` with sentences inside non-first repeated spans taken out of ``text``, and their number n_removed.

    A span is the shortest run of sentences from its start with SENTENCES sentences and WORDS words; case and spacing do
    not count. With ``tails`` the shortest run up to each sentence is a span too, so that short closing sentences of a
    repeated passage go with it. Of equal spans in all documents, or at two places of one, the first by (doc_id, place)
    stays, and every sentence that another one covers goes, however short the repeated stretch is. Null and empty texts
    have no sentence and stay as they are, and a document stays even if no sentence does. Null ids come first in order.
    Repeated rows (same id and text) are one occurrence and stay alike. Other columns pass through, but a column
    n_removed of ``docs`` is replaced; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    covered = repeated_spans(docs, tails).select("doc_id", "text_key", F.explode(F.sequence("first", F.col("past") - 1)).alias("i"))
    gone = covered.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("i").alias("gone"))
    names = [c for c in docs.columns if c != "n_removed"]
    own = docs.select(F.struct(*[f"`{c}`" for c in names if c != "text"]).alias("own"), "text")
    match = F.col("own.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    joined = own.join(gone.hint("shuffle_hash"), match, "left").select("own", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                text, n = drop_sentences(text.as_py(), gone) if gone else (text.as_py(), 0)
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["own", "text", "n_removed"])

    schema = T.StructType().add(joined.schema["own"]).add("text", "string").add("n_removed", T.IntegerType())
    out = joined.mapInArrow(rebuild, schema)
    return out.select(*[f"own.`{c}`" if c != "text" else "text" for c in names], "n_removed")
