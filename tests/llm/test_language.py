import random
import zlib

from lamella.llm import language

SYLLABLES = {"aa": ["ka", "ta", "ro", "mi"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "lho", "que", "nha"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy(spark):
    rows = corpus()
    special = [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1004, "½ ² ① 7", None), (1003, "kataro " * 4000, None), (None, "ungver einsch", "bb"), (5, rows[5][1], rows[5][2])]
    out = language.identify(frame(spark, rows + special)).collect()
    assert len(out) == len(rows) + len(special)
    truth = {i: l for i, _, l in rows}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    by = {r.doc_id: r for r in out}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1000, 1001, 1002, 1004))
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_labels_are_not_learned_from(spark):
    rows = corpus()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else l) for i, t, l in rows]
    same = lambda r: sorted((x.doc_id, x.lang_pred) for x in language.identify(frame(spark, r)).collect())
    assert same(rows) == same(wrong)


def test_codewords_are_apart():
    for n in (1, 2, 4, 12):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert n < 2 or min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


def test_nothing_to_learn_and_empty(spark):
    rows = [(i, "some text", None) for i in range(5)]
    assert {r.lang_pred for r in language.identify(frame(spark, rows)).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


def test_keep_identified(spark):
    rows = corpus(60) + [(900, None, "aa"), (901, "...", "aa")]
    rows[7] = (7, rows[7][1], None)
    truth = corpus(60)[7][2]
    kept = language.keep_identified(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert {r.doc_id: r.lang for r in kept.collect()}[7] == truth
    unlabelled = [(i, t, None) for i, t, _ in rows]
    assert sorted(r.doc_id for r in language.keep_identified(frame(spark, unlabelled)).collect()) == list(range(60))
    assert language.keep_identified(frame(spark, [])).count() == 0


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang").collect()}
    held = [r for r in language.identify(docs).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_sample_is_bounded_and_even(spark):
    rows = [(i, "ab cd", "x" if i % 50 else "y") for i in range(3000)] + [(1, "other text", "x")] * 500
    ids = language._chosen_ids(frame(spark, rows).select("lang", "doc_id"), 100)
    assert len(ids) == len(set(ids)) == 100 and sum(name == "y" for name, _ in ids) == 50
