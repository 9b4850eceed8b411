import hashlib
import random
import re

from lamella.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = lowered(text)
        if w:
            for i in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w = lowered(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        ids = sorted(str(i) for i in found)
        out.append((doc is None, doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "k", 3) for i, t in docs], "doc_id long, text string, item_id string, w int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    rows = decontaminate.contamination(d, b).collect()
    return sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "and", "É", "é", "Über", "x1", "ZZ"] + [f"r{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randint(5, 40))) for i in range(20)] + [(100, "the of"), (101, "Zz"), (102, None), (103, "..."), (104, text(13)), (5, "and the")]
    docs = []
    for d in range(120):
        t = text(rng.randint(0, 120))
        if d % 3 == 0:
            source = [x for x in items if x[1]][rng.randrange(20)][1]
            t = t + ", " + source.upper().replace("É", "é" if d % 2 else "É") + "; " + text(20)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (None, items[0][1]), (7, docs[7][1]), (7, items[1][1])]
    got, want = run(spark, docs, items), brute(docs, items)
    assert got == want
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    (row,) = run(spark, [(1, "a b")], [])
    assert row[2:5] == (2, 0, 0) and row[-1] is False


def test_clean_and_proximity(spark):
    item = " ".join(f"q{i}" for i in range(20))
    near = " ".join(f"q{i}" if i % 3 else f"q{i} extra" for i in range(20))
    docs = spark.createDataFrame([(1, "plain words only"), (2, item), (3, near)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 3]
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, bench).collect()} == {2, 3}


def test_clean_keeps_rows_by_their_own_text(spark):
    item = " ".join(f"w{chr(97 + i)}" for i in range(14))
    docs = [(1, item, 5), (1, "an innocent text under the same id", 6), (None, "x " + item, 7), (None, None, 8), (2, "", 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, text_key int")
    kept = decontaminate.clean(frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == frame.columns and sorted(r.text_key for r in kept.collect()) == [6, 8, 9]
