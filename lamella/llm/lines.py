"""Near-duplicate lines across documents by a deletion-neighbourhood join; the earliest line stays.

An edit is a word in lines of EDIT_WORDS words or more and a character in shorter lines and those without blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import broadcast_if_small, sliced, stored, text_batches

#: From so many words on a line may differ from an earlier one by a word put in, left out or replaced.
EDIT_WORDS = 8
#: A line of fewer words, but so many characters, may differ by a character.
EDIT_CHARS = 20
#: So many lines, of some 50 bytes each, are broadcast to the documents they stand in; more are joined by shuffle.
BROADCAST_LINES = 150_000
#: So many shared keys of 8 bytes are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: A shared half is looked for first, for all lines; then, for those that share one, all but one of so many parts.
PARTS = 8
KEYS = ("k0", "k1", "k2", "k3")


def line_words(line: str) -> list[str]:
    return line.lower().split()


def units(words: list[str], edit_words: int = EDIT_WORDS, edit_chars: int = EDIT_CHARS) -> list[str]:
    """What an edit changes: the words of a line, or the characters of a line of few words; none if it is too short for edits."""
    if len(words) >= edit_words:
        return words
    spelled = " ".join(words)
    return list(spelled) if len(spelled) >= edit_chars else []


def _two(data: str) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(data.encode("utf-8", "surrogatepass"))
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def part_keys(words: list[str], parts: int, tag: str = "") -> list[tuple[int, int, int, int]]:
    """(which, key, low, high): keys of which two lines within one edit share at least one.

    A line is cut into ``parts`` for the length of the shorter line of a pair, which is its own or one word less. An edit
    falls into one part, so the words outside it are equal; the key digests them with the length, the part and ``tag``.
    Words ``low`` up to ``high`` of this line are where the edit may be.
    """
    n, keys = len(words), []
    for longer in (0, 1):
        short = n - longer
        for j in range(parts):
            low, high = j * short // parts, (j + 1) * short // parts + longer
            outside = f"{tag}{short} {j} " + " ".join(words[:low]) + " / " + " ".join(words[high:])
            keys.append((longer * parts + j, _two(outside)[0], low, high))
    return keys


def variants(words: list[str], which: set[int], parts: int, tag: str = "") -> list[tuple[int, int, int]]:
    """The deletion neighbourhood as hashed keys with a role: equal keys prove one edit, whatever the group's size.

    Only words of the parts in ``which``, where some other line agrees outside, are left out. Role 0: the line without its
    p-th word, keyed with its length and p; two such lines differ in that word. Role 1: the line without a word. Role 2: the
    line itself, met by role 1 of a line with one word more.
    """
    n, found = len(words), set()
    for k, _, low, high in part_keys(words, parts, tag):
        if k not in which:
            continue
        if k < parts:
            found.add((*_two(f"{tag}i " + " ".join(words)), 2))
        for p in range(low, high):
            rest = " ".join(words[:p] + words[p + 1 :])
            found.add((*_two(f"{tag}r{n},{p} " + rest), 0) if k < parts else (*_two(f"{tag}i " + rest), 1))
    return sorted(found)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether word lists differ by at most one word put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _tag(words: list[str], edit_words: int) -> str:
    """Keeps keys of words and of characters apart."""
    return "" if len(words) >= edit_words else "c"


def _occurrences(docs: DataFrame, least_words: int, edit_words: int, edit_chars: int) -> DataFrame:
    """(doc_id, text_key, line, c1, c2, half keys) for every line of enough words; c1 and c2 digest its words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            at, line_no, c1, c2, keys = [], [], [], [], []
            none = [None] * 4
            for i, text in enumerate(batch.column(2)):
                for j, line in enumerate((text.as_py() or "").split("\n")):
                    words = line_words(line)
                    if len(words) >= least_words:
                        x, y = _two(" ".join(words))
                        at.append(i), line_no.append(j), c1.append(x), c2.append(y)
                        own = units(words, edit_words, edit_chars)
                        keys.append([k[1] for k in part_keys(own, 2, _tag(words, edit_words))] if own else none)
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line_no, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())]
            columns += [pa.array([k[j] for k in keys], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "line", "c1", "c2", *KEYS])

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(digest, f"doc_id {kind}, text_key bigint, line int, c1 bigint, c2 bigint, " + ", ".join(f"{k} bigint" for k in KEYS))


def _survivors(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c1, c2, first, line) of the classes that share half a line with another class, with their line's text."""
    keyed = classes.where("k0 IS NOT NULL").select("c1", F.explode(F.array_distinct(F.array(*KEYS))).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "line-halves")
    sharing = keyed.join(broadcast_if_small(shared, BROADCAST_KEYS), "key", "left_semi").select("c1").distinct()
    near = stored(classes.select("c1", "c2", "first").join(sharing, "c1", "left_semi"), "line-near")
    per_doc = near.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("c1", "c2", F.col("first.line").alias("line"))).alias("asked"))
    if near.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        per_doc = F.broadcast(per_doc)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    met = own.join(per_doc.alias("a"), F.expr("d.doc_id <=> a.doc_id AND d.text_key = a.text_key"))
    asked = met.select("d.doc_id", "d.text_key", F.split("text", "\n", -1).alias("lines"), F.explode("asked").alias("c"))
    first = F.struct("doc_id", F.col("c.line").alias("line"), "text_key")
    return asked.select("c.c1", "c.c2", first.alias("first"), F.element_at("lines", F.col("c.line") + 1).alias("line")).distinct()


def near_first(docs: DataFrame, classes: DataFrame, edit_words: int = EDIT_WORDS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(c1, c2, kept) for classes with an earlier line within one edit; ``kept`` is where the earliest of them stands."""
    halves = stored(_survivors(docs, classes), "line-halves-texts")
    place = halves.schema["first"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            at, which, key = [], [], []
            for i, line in enumerate(batch.column(3).to_pylist()):
                words = line_words(line)
                for k, x, _, _ in part_keys(units(words, edit_words, edit_chars), PARTS, _tag(words, edit_words)):
                    at.append(i), which.append(k), key.append(x)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(which, pa.int32()), pa.array(key, pa.int64())], names=["c1", "c2", "which", "key"])

    fine = stored(halves.mapInArrow(keys, "c1 bigint, c2 bigint, which int, key bigint").distinct(), "line-parts")
    # Aggregates are stored before they are joined, so that both sides are dealt anew and a hot key can be split.
    shared = stored(fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "line-shared-parts")
    open_parts = fine.join(broadcast_if_small(shared, BROADCAST_KEYS), "key", "left_semi").groupBy("c1", "c2").agg(F.collect_set("which").alias("which"))
    found = stored(halves.join(open_parts, ["c1", "c2"]).select("c1", "c2", "first", "line", "which"), "line-survivors")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            at, v1, v2, role = [], [], [], []
            for i, (line, which) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                words = line_words(line)
                for x, y, r in variants(units(words, edit_words, edit_chars), set(which), PARTS, _tag(words, edit_words)):
                    at.append(i), v1.append(x), v2.append(y), role.append(r)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(v1, pa.int64()), pa.array(v2, pa.int64()), pa.array(role, pa.int32())], names=["c1", "c2", "first", "v1", "v2", "role"])

    rows = stored(found.mapInArrow(emit, f"c1 bigint, c2 bigint, first {place}, v1 bigint, v2 bigint, role int"), "line-variants")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("first")))
    groups = rows.groupBy("v1", "v2").agg(F.count("*").alias("n"), least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2")).where("n > 1").drop("n")
    met = rows.join(stored(groups, "line-variant-groups"), ["v1", "v2"]).select(
        "c1", "c2", "first", F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1")).alias("kept")
    )
    earliest = met.where("kept < first").groupBy("c1", "c2", "first").agg(F.min("kept").alias("kept"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda line: units(line_words(line), edit_words, edit_chars)
        for batch in batches:
            same = [within_one_edit(own(a), own(b)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:3], names=["c1", "c2", "kept"])

    texts = found.select("c1", "c2", "first", "line")
    pairs = (
        earliest.alias("e")
        .join(texts.alias("t"), F.expr("e.c1 = t.c1 AND e.c2 = t.c2 AND e.first <=> t.first"))
        .join(texts.alias("k"), F.expr("e.kept <=> k.first"))
        .select("e.c1", "e.c2", "e.kept", F.col("t.line").alias("line"), F.col("k.line").alias("kept_line"))
    )
    return pairs.mapInArrow(verify, f"c1 bigint, c2 bigint, kept {place}").groupBy("c1", "c2").agg(F.min("kept").alias("kept"))


def repeated_lines(docs: DataFrame, least_words: int = 1, edit_words: int = EDIT_WORDS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(doc_id, text_key, line, kept): the lines to remove, by number from 0, and where the line that stands for them is."""
    every = stored(_occurrences(docs, max(least_words, 1), edit_words, edit_chars), "lines")
    place = F.struct("doc_id", "line", "text_key")
    classes = every.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in KEYS])
    classes = stored(classes, "line-classes")
    near = near_first(docs, classes, edit_words, edit_chars)
    judged = classes.select("c1", "c2", "first", "n").join(near, ["c1", "c2"], "left").where("n > 1 OR kept IS NOT NULL")
    # Stored, so that the join shuffles both sides and a line of a third of all documents can be split.
    judged = stored(judged.select("c1", "c2", F.coalesce("kept", "first").alias("kept")), "line-verdicts")
    met = every.select("doc_id", "text_key", "line", "c1", "c2").join(judged, ["c1", "c2"])
    return met.where("NOT (struct(doc_id, line, text_key) <=> kept)").select("doc_id", "text_key", "line", "kept")


def without_repeated_lines(docs: DataFrame, least_words: int = 1, edit_words: int = EDIT_WORDS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and columns n_lines and n_removed.

    A line of ``least_words`` words or more (1: every line that is not blank) goes if an earlier line, by (doc_id, line
    number), has the same words; from ``edit_words`` words on also if an earlier one is within one word put in, left out
    or replaced, and with fewer words but ``edit_chars`` characters if one such line is within one character. Case and
    spacing do not count. "Earlier" looks at all lines, those that go included, so the outcome does not depend on any
    order of work. Other lines stay as they are, and a document stays even if no line does. Null texts stay null, with 0
    lines. Null ids come first in order. Rows that share a doc_id are judged by their own texts; repeated rows, equal in
    id and text, are one occurrence and stay alike. Other columns pass through, but columns n_lines and n_removed of
    ``docs`` are replaced; an empty table gives an empty result.
    """
    gone = repeated_lines(docs, least_words, edit_words, edit_chars)
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    match = F.col("own.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    joined = docs.select(F.struct(*[f"`{c}`" for c in names if c != "text"]).alias("own"), "text").join(gone.hint("shuffle_hash"), match, "left")
    lines = F.split("text", "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    absent = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(numbered, lambda x: ~F.array_contains(absent, x["i"]))
    out = joined.select("own", F.when(F.size(absent) == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.size(absent).alias("n_removed"))
    return out.select(*[f"own.`{c}`" if c != "text" else "text" for c in names], "n_lines", "n_removed")
