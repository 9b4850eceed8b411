import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lamella.llm import packing, tokens
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, don't they're WE'LL x's 12 345!!",
    "Élan ÀÉ straße İstanbul ŉ ǅ ﬁ ſÅΩ",
    "tabs\tand\r\nlines\n\n  blanks ",
    "odd\x0bspaces\x0c\x1c!\x1c?\x85next\xa0to these　ones x",
    "é café ́alone äb",
    "ΑΣ ΣΑΣ. ΌΔΟΣ Привет ПРИВЕТ",
    "漢字かな交じり文と한국어 mixed ไทย",
    "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>c<|endoftext|><|endoftext|>",
    "'s 't're ''ve ’s _under_score_ #*$%&|<>",
    "\U0001f600\U0001f468‍\U0001f469 ­ soft­hyphen ﻿ bom",
    "",
    " ",
    "\x00nul\x00",
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(library):
    own = tokens.ChunkEncoder(PATH, most=20)
    rng = np.random.default_rng(0)
    mixed = [" ".join(rng.choice(TEXTS, 3)) for _ in range(60)] + ["".join(rng.choice(TEXTS, 2)) for _ in range(60)]
    for text, packed in zip(TEXTS + mixed, own.encode(TEXTS + mixed)):
        assert np.frombuffer(packed, "<u4").tolist() == ids_of(library, text), repr(text)
    assert len(own.known) <= 21


def test_counts_and_cache(spark, library, tmp_path):
    rows = list(enumerate(TEXTS)) + [(90, None), (91, TEXTS[0]), (None, TEXTS[1]), (0, TEXTS[0]), (92, "tabs and lines blanks")]
    docs = spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, content string, n_tokens long")
    cache = str(tmp_path / "cache")
    want = sorted(
        ((i is None, i or 0, len((t or "").encode()), len(ids_of(library, t or "")), len(ids_of(library, t or "")) > 10) for i, t in rows)
    )
    for _ in range(2):
        out = tokens.token_counts(docs, PATH, cache, limit=10)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    before = spark.read.parquet(cache).count()
    others = spark.createDataFrame([(1, TEXTS[2]), (2, "a new text"), (3, "a  new\ntext")], "doc_id long, text string")
    tokens.token_counts(others, PATH, cache)
    assert spark.read.parquet(cache).count() == before + 1  # the rest is not encoded again
    tokens.compacted(spark, cache, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == before + 1
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()
    assert stored.where("tokenizer IS NULL").count() == 0
    assert tokens.token_counts(docs.limit(0), PATH, str(tmp_path / "other")).count() == 0


def test_nnls_is_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert x.min() >= 0 and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


def check_packing(rows, out, library, window):
    got = {}
    for r in out:
        got.setdefault((r.doc_id is None, r.doc_id), []).append(r)
    whole = {}
    for i, t in rows:
        whole.setdefault((i is None, i), []).append([*ids_of(library, t or ""), 2])
    assert got.keys() == whole.keys()
    for key, texts in whole.items():
        ids = texts[0]
        parts = sorted(got[key], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in parts)
        at = 0
        for r in parts[:: len(texts)]:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in out) / (window * len(sequences))


def test_packing(spark, library):
    rng = np.random.default_rng(2)
    rows = list(enumerate(TEXTS)) + [(90, None), (None, TEXTS[0]), (91, TEXTS[2]), (91, TEXTS[2])]
    rows += [(100 + i, " ".join(rng.choice(["some", "words", "here", "élan"], int(n)))) for i, n in enumerate(rng.lognormal(3, 1, 400))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    out = packing.pack(docs, PATH, window=256).collect()
    assert check_packing(rows, out, library, 256) > 0.97
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_small_shards_keep_every_piece(spark, library):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(300)], "doc_id long, text string")
    cut = packing.pieces(docs, PATH, 64)
    out = packing.packed(cut.cache(), window=64, unit=4, shard_rows=40).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], out, library, 64)


def test_pieces_carry_ids(spark, library):
    docs = spark.createDataFrame([(1, "word " * 10)], "doc_id long, text string")
    rows = packing.pieces(docs, PATH, 4, ids=True).orderBy("start").collect()
    assert [len(r.ids) for r in rows] == [4, 4, 3]
    assert [i for r in rows for i in r.ids] == [*ids_of(library, "word " * 10), 2]


def test_tokenizers_that_see_blanks_get_whole_texts(spark, tmp_path):
    assert tokens.drops_blanks(PATH)
    names = [n for n in os.listdir(os.path.dirname(PATH)) if n.endswith((".json", ".model"))]
    texts = ["Two  blanks\n\nand lines", " leading and trailing ", "plain words", "", "<s> é 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    seen = 0
    for name in names:
        path = public_tokenizers.path(name)
        try:
            blank = tokens.drops_blanks(path)
        except Exception:  # not a tokenizer
            continue
        if blank:
            continue
        seen += 1
        if name.endswith(".model"):
            want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
        else:
            library = Tokenizer.from_file(path)
            library.no_padding(), library.no_truncation()
            want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        got = tokens.token_counts(docs, path, str(tmp_path / name)).orderBy("doc_id").collect()
        assert [r.n_tokens for r in got] == want, name
    assert seen >= 1


def test_a_repeated_id_is_dealt_over_shards(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "word " * (i % 90)) for i in range(6000)], "doc_id long, text string")
    out = packing.packed(packing.pieces(docs, PATH, 64).cache(), window=64, unit=4, shard_rows=500).collect()
    shards = Counter(r.sequence_id >> 32 for r in out)
    assert len(shards) >= 10 and max(shards.values()) < 3 * len(out) / len(shards)
