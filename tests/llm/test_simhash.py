import random
from collections import defaultdict

import numpy as np
import xxhash
from lamella.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_prints):
    prints = sorted({f for _, f in ids_prints})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(prints):
        for g in prints[:i]:
            if bin(f ^ g).count("1") <= 2:
                root[find(f)] = find(g)
    least = defaultdict(list)
    for d, f in ids_prints:
        least[find(f)].append(d)
    return {f: min((d for d in least[find(f)] if d is not None), default=None) for f in prints}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "naïve", "ZED"]
    base = [rng.choices(vocab, k=rng.randint(60, 300)) for _ in range(30)]
    rows = []
    for n in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((n, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "One two"), (305, "a b c"), (None, "one"), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component long")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    least = plain_components(prints)
    want = sorted((d is None, d, f"{f:016x}", least[f]) for d, f in prints)
    assert got == want
    assert len({c for *_, c in got}) < len(got) - 60


def test_links_are_complete_in_a_dense_cluster(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        f = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            f ^= 1 << b
        prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    from lamella.llm.common import components

    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    got = {r.node % (1 << 64): r.component for r in found}
    want = plain_components([(f, f) for f in prints])
    groups = lambda named: sorted(sorted(f for f in prints if named.get(f, f) == c) for c in {named.get(f, f) for f in prints})
    assert groups(got) == groups(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text), (5, text), (9, "other words here entirely"), (None, text)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()].count((None, text)) == 1
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs).collect()) == [-1, 9]
    odd = [(1, "same id one", 5, 2.0), (1, "same id two", 5, None), (2, None, 1, 1.0), (3, " \n", 1, 1.0), (4, "dup", 3, 1.0), (4, "dup", 3, 1.0), (4, "dup", 2, 1.0)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, node int, rank double")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "same id one"), (1, "same id two"), (2, ""), (4, "dup")]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_links_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(500)]
    common = " ".join(rng.choices(vocab, k=40))
    texts = []
    for n in [6, 8, 12, 20, 30, 45, 50, 60, 90, 150, 300, 800, 3000]:
        for _ in range(6):
            base = rng.choices(vocab, k=n)
            texts.append(" ".join(base))
            for _ in range(4):
                words = list(base)
                for _ in range(rng.randint(1, max(1, n // 40))):
                    at = rng.randrange(len(words))
                    words[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
                texts.append(" ".join(words))
    texts += [common + " " + " ".join(rng.choices(vocab, k=60)) for _ in range(60)]
    texts = sorted(set(texts))
    want = {(b, a) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    docs = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "node string, text string")
    got = {tuple(sorted((int(r.a), int(r.b)))) for r in simhash.similar_links(docs).collect()}
    assert got <= want
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert len(want) > 250 and sum(find(a) == find(b) for a, b in want) >= 0.97 * len(want)


def test_the_grid_is_dealt_over_all_tasks(spark):
    prints = spark.range(100).select(simhash.F.xxhash64("id").alias("fp"))
    plan = simhash.in_cells(prints, 32)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_links_that_only_the_grid_finds(spark):
    """Two texts of a similarity of 5 in 6 whose classes share no fingerprint, but whose whole fingerprints are equal."""
    def keys(text):
        return set(simhash.segment_prints(np.unique(simhash.shingle_hashes(text, 5))).tolist())

    for i in range(20000):
        one = " ".join([f"w{i} x{i} y{i} z{i} v{i}"] * 20)
        if not keys(one) & keys(one + " end"):
            break
    assert not keys(one) & keys(one + " end")
    assert simhash.fingerprint(one, 5) == simhash.fingerprint(one + " end", 5)
    docs = spark.createDataFrame([("1", one), ("2", one + " end"), ("3", "nothing like these two at all, not in one word")], "node string, text string")
    assert [tuple(sorted(r)) for r in simhash.similar_links(docs).collect()] == [("1", "2")]


def hidden_pair():
    """Two alike texts after texts unlike them and each other, one of which shares every group that the two share."""
    def groups(text):
        own = simhash.segment_prints(np.unique(simhash.shingle_hashes(text, 5))).tolist()
        f = simhash.fingerprint(text, 5)
        return {(c, *s) for c in own for s in ((), (f >> 56,), (f >> 48 & 255, 1))}

    rng = random.Random(13)
    base = [f"u{i}" for i in range(240)]
    edited = lambda n: " ".join(w if i not in at else f"e{rng.random()}" for at in [set(rng.sample(range(240), n))] for i, w in enumerate(base))
    while True:
        one, two = edited(2), edited(2)
        if jaccard(one, two) >= 0.8 and (simhash.fingerprint(one, 5) ^ simhash.fingerprint(two, 5)).bit_count() > 2:
            break
    hidden, others = groups(one) & groups(two), []
    while hidden:
        text = edited(6)
        if groups(text) & hidden and max(jaccard(text, t) for t in (one, two, *others)) < 0.8:
            others.append(text)
            hidden -= groups(text)
    return [*others, one, two]


def test_no_link_is_missed(spark):
    """Members of a group were held against its smallest one only."""
    texts = hidden_pair()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    nodes = docs.selectExpr("lpad(doc_id, 4, '0') AS node", "text")
    assert simhash.fingerprint_links(nodes).count() == 0
    assert [(int(r.a), int(r.b)) for r in simhash.rest_links(nodes, spark.createDataFrame([], "node string, component string"), 5, 0.8).selectExpr("least(a, b) a", "greatest(a, b) b").collect()] == [(len(texts) - 2, len(texts) - 1)]


def test_members_unlike_the_first_are_linked(spark):
    """Two texts alike that share their fingerprints' groups with smaller, unlike ones."""
    words = [f"k{i}" for i in range(60)]
    docs = spark.createDataFrame([("0", " ".join(words)), ("1", " ".join(words[:52] + ["x"] * 8)), ("2", " ".join(words[4:] + ["y"] * 4))], "node string, text string")
    rows = {r.node: r.text for r in docs.collect()}
    want = {(a, b) for a in rows for b in rows if a < b and jaccard(rows[a], rows[b]) >= 0.8}
    none = spark.createDataFrame([], "node string, component string")
    assert {tuple(sorted(r)) for r in simhash.rest_links(docs, none, 5, 0.8).collect()} == want
    assert simhash.rest_links(docs.limit(0), none, 5, 0.8).count() == 0
