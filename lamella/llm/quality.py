"""Quality rules as a ledger of bitmasks: every rule is evaluated once, policies and ablations are bit operations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut, sliced, text_batches

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "toxicity")
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Latin-1, Greek and Cyrillic capitals.
CAPITALS = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+")
STRIPPED = ".,;:!?\"'()[]#*$%&|<>"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word stands for itself and, if it is longer, for its first so many letters, as inflection changes the rest.
STEMS = (5, 6, 7)
#: Features seen less often in toxic texts, or in fewer of them, are not learned, nor those of under 3 letters.
LEAST_SEEN, LEAST_TEXTS = 20, 6
#: A feature weighs the power of two by which it is commoner in toxic texts than in others, from 2 to this.
MOST_WEIGHT = 12


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` (a power of two) that occur twice or more, the first occurrence included.

    Windows are named exactly by doubling: pairs of names of half the width get a name of their own.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    names, size = ids.astype(np.int64), 1
    counts = np.zeros(0, dtype=np.int64)
    while size < width:
        pairs = names[:-size] * (int(names.max()) + 1) + names[size:]
        distinct, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        size *= 2
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[names] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def word_features(word: str) -> list[str]:
    """A word without case and outer marks, and its stems (ending in a dash)."""
    word = word.translate(ASCII_LOWER).strip(STRIPPED)
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def lexicon(docs: DataFrame, labels: DataFrame, most_docs: int = 50_000) -> dict[str, int]:
    """Weights of words and stems that toxic texts have more often than others, in any language.

    ``labels(doc_id, toxic)`` marks some of ``docs(doc_id, text)``. Occurrences are counted over all labelled texts, or, if
    there are more than ``most_docs`` labels, over about so many of them, chosen by a hash of the id; this bounds what the
    driver gets. Null labels and ids are not used; of several labels for one id the largest counts.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > most_docs:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_docs / n))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in sliced(batches, 50):
            seen, texts, total = {}, {}, [0, 0]  # type: tuple[dict[str, list[int]], dict[str, int], list[int]]
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words, own = Counter((text.as_py() or "").encode("utf-8", "surrogatepass").split()), set()
                total[toxic] += sum(words.values())
                for raw, times in words.items():
                    word = raw.decode("utf-8", "surrogatepass")
                    for f in known.get(word) or known.setdefault(word, [f for f in word_features(word) if len(f) > 2]):
                        seen.setdefault(f, [0, 0])[toxic] += times
                        if toxic and f not in own:
                            own.add(f)
                            texts[f] = texts.get(f, 0) + 1
            if len(known) > 20_000:
                known.clear()
            rows = [(f, c, t, texts.get(f, 0)) for f, (c, t) in seen.items()] + [(None, *total, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["feature", "clean", "toxic", "texts"])

    text_batches(docs.sparkSession)
    bounded = F.broadcast(marked)  # about most_docs rows at most
    labelled = docs.select("doc_id", "text").join(bounded, "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = labelled.mapInArrow(counted, "feature string, clean bigint, toxic bigint, texts bigint")
    counts = cut(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "texts")]))
    total = counts.where("feature IS NULL").first()
    if total is None or not total["toxic"]:
        return {}
    frequent = counts.where(f"feature IS NOT NULL AND toxic >= {LEAST_SEEN} AND texts >= {LEAST_TEXTS}").where(F.col("toxic").cast("double") * total["clean"] >= 3.9 * (F.col("clean") + 1) * total["toxic"])
    found = {}
    for r in frequent.collect():  # words that are frequent in at most most_docs texts
        ratio = r["toxic"] * total["clean"] // ((r["clean"] + 1) * total["toxic"])
        if ratio >= 4:
            found[r["feature"]] = min(ratio.bit_length() - 1, MOST_WEIGHT)
    return found


def measures(text: str | None, weights: dict[str, int] | None = None, known: dict[str, int] | None = None) -> tuple[int, ...]:
    """The MEASURES of a whole text; a null text has no words. ``known`` keeps weights of words from text to text."""
    text, known = text or "", {} if known is None else known
    words = text.encode("utf-8", "surrogatepass").split()
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    toxicity = 0
    if weights:
        heavy = np.zeros(len(names), dtype=np.int64)
        for word, i in names.items():
            if word not in known:
                known[word] = max((weights.get(f, 0) for f in word_features(word.decode("utf-8", "surrogatepass"))))
            heavy[i] = known[word]
        toxicity = int(heavy[ids].sum()) if len(ids) else 0
    letters = NOT_LETTERS.sub("", text)
    n_letters = len(letters) if letters.isalpha() else sum(map(str.isalpha, letters))
    upper = len(text) - len(CAPITALS.sub("", text))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, n_letters, toxicity


@dataclass(frozen=True)
class Rule:
    """A named condition that a failing document meets; ``bit`` is its place in the mask and never reused."""

    name: str
    bit: int
    fails: str


#: Comparisons are on integers, so that every engine agrees. Bit 8 was a list of insults and stays unused.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
    Rule("capitals", 6, "2 * n_upper > n_letters"),
    Rule("few_letters", 7, "2 * n_letters < word_chars"),
    Rule("toxic", 9, "20 * toxicity >= n_words + 120"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject. An old version stays as it was, to be compared with.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "repeated_lines", "capitals"), 4: tuple(r.name for r in RULES)}
LATEST = max(POLICIES)


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def ledger(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``(doc_id, measures..., failed)`` for every row of ``docs(doc_id, text)``; ``failed`` has a bit per failed rule.

    Whole texts are measured; ``toxicity`` sums the ``weights`` of their words (see ``lexicon``; none: 0). A null or empty
    text has zero measures and fails ``few_words``. Repeated rows and null ids stay as they are; other columns are
    ignored; an empty table gives an empty ledger.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in sliced(batches, 200):
            if len(known) > 50_000:
                known.clear()
            rows = np.array([measures(t.as_py(), weights, known) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], names=["doc_id", *MEASURES])

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    failed = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in RULES), F.lit(0).cast("long"))
    return docs.select("doc_id", "text").mapInArrow(measured, schema).withColumn("failed", failed)


def fails(version_or_names: int | tuple[str, ...]) -> Column:
    """Whether a row of the ledger fails a policy: any of its bits is set."""
    names = POLICIES[version_or_names] if isinstance(version_or_names, int) else version_or_names
    return F.col("failed").bitwiseAND(F.lit(mask(names))) != 0


def ablation(entries: DataFrame, version: int = LATEST) -> DataFrame:
    """``(rule, n_failed, n_only)`` of a policy: rows that fail the rule, and rows that only this rule rejects."""
    own = mask(POLICIES[version])
    held = F.col("failed").bitwiseAND(F.lit(own))
    sums = []
    for r in RULES:
        if own >> r.bit & 1:
            hit = (held.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("long")
            only = (held == (1 << r.bit)).cast("long")
            sums.append((r.name, F.coalesce(F.sum(hit), F.lit(0)), F.coalesce(F.sum(only), F.lit(0))))
    totals = entries.agg(F.array(*[F.struct(F.lit(n).alias("rule"), a.alias("n_failed"), b.alias("n_only")) for n, a, b in sums]).alias("t"))
    return totals.select(F.inline("t"))


def judged(docs: DataFrame, labels: DataFrame | None = None, version: int = LATEST) -> DataFrame:
    """The ledger, with toxicity learned from ``labels``, base_failed and kept under a policy version."""
    return ledger(docs, None if labels is None else lexicon(docs, labels)).withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE) & ~fails(version))
