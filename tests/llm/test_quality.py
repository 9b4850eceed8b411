import random
import re

import numpy as np
from lamella.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


SOUND = " ".join("qr" + chr(97 + i % 26) * (1 + i // 26) for i in range(40))


def samples():
    rng = random.Random(8)
    vocab = ["a", "b", "É", "c|d", "x#", "漢字", "\xa0", "\x1c", "e f"]
    out = [None, "", " \n\t", "one", "\n".join(["same line"] * 4), " ".join("abcdefgh"), " ".join("abcdefgh" * 2), "\x0b \x0c\r"]
    for n in (3, 20, 60, 200):
        out += [rng.choice([" ", "\n", " \n "]).join(rng.choices(vocab[: rng.randint(1, 9)], k=n)) for _ in range(12)]
    out.append(" ".join([f"w{i}" for i in range(30)] * 2 + [f"v{i}" for i in range(40)]))
    return out


def test_measures():
    for text in samples():
        assert quality.measures(text)[:5] == plain(text), repr(text)


def test_repeated_words_of_one_word():
    assert quality.repeated_words(np.zeros(30, dtype=np.int64)) == 30


def test_ledger_policies_and_ablation(spark):
    texts = samples() + ["½ ² ① " * 4 + SOUND, SOUND]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, failed int")
    rows = quality.judged(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, _, _, _, repeats = plain("x" if r.doc_id is None else texts[r.doc_id])
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (r.failed == 0)
    assert {r.doc_id: r.kept for r in rows}[len(texts) - 1] is True
    by_id = {r.doc_id: r for r in rows}
    assert by_id[len(texts) - 2].n_letters == by_id[len(texts) - 1].n_letters == len(SOUND.replace(" ", ""))
    failed = [r.failed for r in rows]
    for r in quality.ablation(quality.ledger(docs)).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == sum(bool(f & bit) for f in failed) and r.n_only == sum(f == bit for f in failed)
    assert len(quality.ablation(quality.ledger(docs), 1).collect()) == 2
    assert quality.judged(docs.limit(0)).count() == 0
    assert all(r.n_failed == 0 for r in quality.ablation(quality.ledger(docs.limit(0))).collect())


def test_toxicity_is_learned_from_labels_in_any_language(spark):
    rng = random.Random(3)
    sound = [["ka", "lo", "mira"], ["отец", "дом", "река"]]
    rude = [["blarg", "Vexoria", "vexorian"], ["грубый", "грубого", "грубому"]]
    docs, labels = [], []
    for i in range(120):
        words, toxic = rng.choices(sound[i % 2], k=40), i % 4 < 2
        if toxic:
            words[5:9] = rng.choices(rude[i % 2], k=4)
        docs.append((i, " ".join(words) + "."))
        if i < 100:
            labels.append((i, int(toxic)))
    docs += [(None, "blarg"), (500, None)]
    labels += [(None, 1), (7, None), (900, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = quality.lexicon(frame, marks)
    assert weights["vexor-"] >= 4 and weights["грубо-"] >= 4
    assert not any(w in weights for w in ("ka", "mira", "дом"))
    rows = {r.doc_id: r for r in quality.ledger(frame, weights).collect()}
    toxic = 1 << 9
    assert all(bool(rows[i].failed & toxic) == (i % 4 < 2) for i in range(120))
    assert quality.lexicon(frame, marks.limit(0)) == {} and quality.lexicon(frame.limit(0), marks) == {}
    assert quality.measures("blarg blarg", weights)[-1] == 2 * weights["blarg"]
