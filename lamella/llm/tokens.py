"""Token counts through a cache of digests: only distinct contents that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import stored, text_batches

#: White space that str.split() splits at beyond blank, tab and line ends.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
SPACES = re.compile("[ \t\n\r]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Marks that a word may end in; none is part of a contraction or of a special token.
MARKS = ".,;:!?*#$%&)]}"
#: Letters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
CACHE_SCHEMA = "tokenizer string, content string, n_tokens bigint"


class ChunkEncoder:
    """Token ids of texts by a tokenizer that never joins tokens over blanks, as packed 32-bit little-endian bytes.

    Such a tokenizer (white space is dropped before merging, as in word_bpe_49k.json) gives a text the ids of its chunks
    between blanks, one after the other. The library encodes each distinct chunk; up to ``most`` short chunks stay known
    from one document to the next, so memory is bounded, and chunks beyond that are encoded anew for each group of texts.
    """

    def __init__(self, path: str, most: int = 250_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[str, bytes] = {"": b""}
        self.most, self.longest = most, longest
        # A lower-case word is one piece for the merges; whether they may be asked directly is tried out on some words.
        self.direct = all(self._whole([w]) == [self._word(w)] for w in ("a", "word", "unforgettable", "élan", "straße", "ñandú", "œuvre"))

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.library.model.tokenize(spelled)]).tobytes()

    def _parts(self, chunk: str) -> tuple[str, str] | None:
        """A lower-case Latin word and the marks after it, if the chunk is no more than that: two pieces for the tokenizer."""
        word = chunk.rstrip(MARKS)
        if self.direct and word.isalpha() and word == word.lower() and not BEYOND_LATIN.search(word):
            return word, chunk[len(word) :]
        return None

    def _add(self, missing: list[str]) -> list[str]:
        """Make ``missing`` known, and the words and marks in them; what has been added."""
        parts = [(c, self._parts(c)) for c in missing]
        odd = {c for c, p in parts if p is None} | {p[1] for _, p in parts if p and p[1] not in self.known}
        added = list(odd)
        self.known.update(zip(added, self._whole(added)))
        for chunk, part in parts:
            if part is not None:
                word, marks = part
                if word not in self.known:
                    self.known[word] = self._word(word)
                    added.append(word)
                if marks:
                    self.known[chunk] = self.known[word] + self.known[marks]
                    added.append(chunk)
        return added

    @staticmethod
    def chunks(text: str) -> list[str]:
        if "<|" not in text and not BEYOND_LATIN.search(text):
            text = text.lower()  # the tokenizer does so itself; fewer distinct chunks this way
        return SPACES.split(text) if OTHER_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        added = self._add([c for c in set().union(*split) if c not in self.known])
        get = self.known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        room = self.most - (len(self.known) - len(added))
        for i, chunk in enumerate(added):
            if i >= room or len(chunk) > self.longest:
                del self.known[chunk]
        return out


class WholeEncoder:
    """Token ids of whole texts as the library gives them, for tokenizers that may join tokens over blanks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self._ids = SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_padding()
            library.no_truncation()
            self._ids = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ids(texts)]


#: Texts on which a tokenizer that sees blanks gives itself away.
PROBES = ["a  b\n\nc\td", "Word word. Word", " leading", "trailing \n", "x\r\ny  \n z", "The end.\n\n\nA start", "1 2  3", "é É\nß"]


def drops_blanks(path: str) -> bool:
    """Whether the ids of texts are those of their chunks between blanks, so that blanks and line ends change nothing."""
    if path.endswith(".model"):
        return False
    whole = WholeEncoder(path)
    return whole.encode(PROBES) == [b"".join(whole.encode(t.split())) for t in PROBES] and ChunkEncoder(path).encode(PROBES) == whole.encode(PROBES)


_encoders: dict[str, ChunkEncoder | WholeEncoder] = {}


def encoder(path: str) -> ChunkEncoder | WholeEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path) if drops_blanks(path) else WholeEncoder(path)
    return _encoders[path]


def encoded(path: str, texts: Iterator[str], group: int = 64) -> Iterator[bytes]:
    """Packed ids of each text, ``group`` texts at a time."""
    texts, own = iter(texts), encoder(path)
    while part := list(islice(texts, group)):
        yield from own.encode(part)


def normalised(text: Column, blanks: bool = True) -> Column:
    """Null as empty; with ``blanks``, for tokenizers that drop them, runs of blanks and line ends as one blank."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, "[ \t\n\r]{2,}|[\t\n\r]", " ") if blanks else text


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: counts of another file, or of another version of it, are other entries."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def compacted(spark: SparkSession, cache_path: str, new_path: str) -> None:
    """Write the cache anew with one entry for each tokenizer and content: appends leave many small files."""
    entries = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    entries.groupBy("tokenizer", "content").agg(F.first("n_tokens").alias("n_tokens")).write.parquet(new_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    Contents are digested after normalisation and joined to the Parquet cache at ``cache_path`` under the tokenizer's
    own digest. Of each content that the cache lacks one document is encoded, whole, and its count appended; the cache
    serves later runs and other tables. Null and empty texts have no bytes and no tokens. Copies and repeated rows share
    one entry and come back as often as they came in. A null doc_id keeps its row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    version = tokenizer_version(tokenizer_path)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([drops_blanks(tokenizer_path)])], names=["blanks"])

    blanks = spark.range(1, numPartitions=1).mapInArrow(probed, "blanks boolean").first()["blanks"]
    text, place = F.coalesce("text", F.lit("")), F.xxhash64("text")
    content = F.sha2(normalised(F.col("text"), blanks), 256)
    keys = stored(docs.select("doc_id", place.alias("place"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    misses = keys.groupBy("content").agg(F.min(F.struct("doc_id", "place")).alias("first")).join(cached, "content", "left_anti")
    misses = misses.select("content", "first.doc_id", "first.place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(ids) // 4 for ids in encoded(tokenizer_path, (t.as_py() for t in batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["content", "n_tokens"])

    own = docs.select("doc_id", place.alias("place"), text.alias("text")).alias("d")
    asked = own.join(misses.hint("shuffle_hash").alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.place = m.place"))
    # Rows that repeat an id and a text are encoded as often as they occur, but append one entry.
    fresh = asked.select("m.content", "d.text").mapInArrow(count, "content string, n_tokens bigint")
    fresh = fresh.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    # Stored, so that both sides of the join are dealt anew and a content of a third of all rows can be split.
    counts = stored(counts.groupBy("content").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
