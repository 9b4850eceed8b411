import random
import re
from collections import Counter, defaultdict

import pytest
from lamella.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=30, top=50):
    counts, texts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall(lower(text))
        counts[lang or "", source or ""].update(words)
        texts[lang or ""].update(set(words))
    out = []
    for lang, of in texts.items():
        kept = sorted(t for t, n in of.items() if n >= least)
        own = {s: [c[t] for t in kept] for (x, s), c in counts.items() if x == lang}

        def shares(n):
            return [1 + 10**9 * (x + 5) // (sum(n) + 5 * len(kept)) for x in n]

        p, q = {s: shares(n) for s, n in own.items()}, shares([sum(c) for c in zip(*own.values())])
        for s in own:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o]))) for o in own if o != s]
            terms = [(t, a - b) for t, a, b, n in zip(kept, p[s], q, own[s]) if n and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2) for i, (lang, s, t) in enumerate(rows)], SCHEMA)


def result(spark, rows, **kw):
    return sorted(map(tuple, divergence.divergence(frame(spark, rows), **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ab", "É", "漢", "Zz", "q\xa0") for b in "abcdefghijkmnopqrstuvwxyz"]
    out = []
    for i in range(600):
        source = rng.choice(["src0"] * 20 + [f"src{j}" for j in range(30)])
        words = [rng.choice(vocab[: 20 + wider(source)]) for _ in range(rng.randint(0, 40))] + ["common"] * rng.randint(0, 9)
        out.append((rng.choice(["en", "en", "de", None, ""]), source, rng.choice([" ", "1", ".", "\n", "_"]).join(words)))
    out += [(None, None, None), ("en", None, ""), ("en", "silent", "12 345 ..."), ("lone", "a", "x y"), ("lone", "b", None), ("one source", "a", "x")]
    return out + out[:40]


def wider(source):
    return int(source[3:]) * 3


def test_equals_plain_version(spark, rows):
    assert result(spark, rows, least_docs=8, terms=5) == plain(rows, 8, 5)


def test_small_chunks_blocks_and_flushes(spark, rows, monkeypatch):
    """Full chunks go on in another one; sources meet in blocks; what a task holds is passed on early."""
    monkeypatch.setattr(divergence, "SOURCES", 4)
    monkeypatch.setattr(divergence, "CHUNKS", 1)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(divergence, "BROADCAST_TERMS", 1)
    assert result(spark, rows, least_docs=3) == plain(rows, 3)


def test_a_chunk_of_more_terms_than_bits(spark):
    rows = [("en", f"s{i % 3}", " ".join("t" + "abcdefghij"[k // 100] + "abcdefghij"[k // 10 % 10] + "abcdefghij"[k % 10] for k in range(900) if (k + i) % 4)) for i in range(6)]
    assert result(spark, rows, least_docs=1) == plain(rows, 1)


def test_no_kept_term_gives_pairs_of_zero(spark):
    rows = [("en", "a", "x"), ("en", "b", "y"), ("en", "b", None)]
    assert result(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == plain(rows)


def test_ties_by_utf8_and_very_long_text(spark):
    rows = [("en", "a", "ZEBRA zebra é ￮ \U00010000 " * 40_000), ("en", "b", "zebra"), ("en", "c", "zebra")]
    assert result(spark, rows, least_docs=1) == plain(rows, 1)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_shares_are_exact_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n = 10**13 + 7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(11)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 55)
