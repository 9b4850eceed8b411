import random
import zlib

import pytest
from lamella.llm import queries, spans


def plain_sentences(text):
    """Character by character; for texts with blanks between words."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text):
            if text[end] == "\n":
                break
            if text[end] in ".!?…":
                close = end
                while close < len(text) and text[close] in ".!?…":
                    close += 1
                while close < len(text) and text[close] in "\"'”’)]":
                    close += 1
                if close < len(text) and text[close].isspace():
                    end = close
                    break
            end += 1
        while end < len(text) and text[end].isspace():
            end += 1
        words = text[at:end].lower().split()
        if len(words) > 14:
            piece = at
            for i in range(at + 1, end):
                if text[i - 1].isspace() and not text[i].isspace() and zlib.crc32(text[:i].lower().split()[-1].encode()) % 10 == 0 and text[at:i].split():
                    out.append((piece, i, text[piece:i].lower().split()))
                    piece = i
            out.append((piece, end, text[piece:end].lower().split()))
        else:
            out.append((at, end, words))
        at = end
    return out


def brute(docs, tails=True):
    """Sentences that go, by document: the shortest run from every start and, with ``tails``, up to every end."""
    rows = set()
    for d, t in docs:
        parts = plain_sentences(t or "")
        runs = []
        long = lambda a, b: b - a >= spans.SENTENCES and sum(len(ws) for _, _, ws in parts[a:b]) >= spans.WORDS  # noqa: B023, E731
        for a in range(len(parts)):
            runs += [(a, b) for b in range(a, len(parts) + 1) if long(a, b)][:1]
        for b in range(len(parts) + 1) if tails else ():
            runs += [(a, b) for a in range(b, -1, -1) if long(a, b)][:1]
        rows |= {(" ".join(w for _, _, ws in parts[a:b] for w in ws), (-1 if d is None else d, a), b) for a, b in runs}
    first = {}
    for key, place, _ in sorted(rows, key=lambda r: r[1]):
        first.setdefault(key, place)
    gone = {}
    for key, place, b in rows:
        if first[key] != place:
            gone.setdefault(place[0], set()).update(range(place[1], b))
    return gone


def corpus():
    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(2, 30))).capitalize() + rng.choice([".", "!", "?", ".)"])
    shared = [" ".join(sentence() for _ in range(5)) for _ in range(6)]
    docs = []
    for d in range(70):
        parts = [sentence() for _ in range(rng.randint(0, 8))]
        if d % 2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        docs.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    long = " ".join(f"z{i}" for i in range(80)) + "."
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, long), (104, "Start here. " + long.upper()), (None, shared[0]), (105, docs[3][1]), (106, "No end " * 9)]
    return docs


def test_sentences_cover_the_text():
    for _, t in corpus():
        parts = spans.sentences(t or "")
        assert parts == plain_sentences(t or "")
        assert "".join((t or "")[a:b] for a, b, _ in parts) == (t or "")
    assert [w for _, _, w in spans.sentences("One two. Three!\nfour")] == [["one", "two."], ["three!"], ["four"]]


@pytest.mark.parametrize("tails", [True, False])
def test_against_brute_force(spark, tails):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "f", 3) for d, t in docs], "doc_id long, text string, first string, gone int")
    rows = spans.without_repeated_spans(df, **({} if tails else {"tails": False})).collect()
    gone = brute(docs, tails)
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in rows}
    assert len(got) == len(rows) == len(docs) and len(gone) > 20
    for d, t in docs:
        key = -1 if d is None else d
        want = t if t is None else "".join(t[a:b] for i, (a, b, _) in enumerate(plain_sentences(t)) if i not in gone.get(key, ()))
        assert got[key].text == want
        assert got[key].n_removed == len(gone.get(key, ()))
        assert got[key].first == "f"
    assert got[105].text == "" or len(docs[3][1].split()) < spans.WORDS


def test_repeated_rows_and_empty(spark):
    text = "A first sentence of several words here. And a second one that adds many more words to it."
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in spans.without_repeated_spans(df).collect()) == [(1, text), (1, text), (2, "")]
    assert spans.without_repeated_spans(df.limit(0)).count() == 0


def test_short_closing_sentences_go(spark):
    """Sentences of 12, 12, 5 and 4 words, repeated at the end of a text, before other text and by the registered query."""
    said = [" ".join(f"{c}{i}" for i in range(n)) + "." for c, n in (("a", 12), ("b", 12), ("c", 5), ("d", 4))]
    passage = " ".join(said)
    docs = [(1, passage), (2, passage), (3, passage + " Then other words follow here, more than sixteen of them in all, so that runs reach into this text.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.without_repeated_spans(df).collect()}
    assert got[1] == (passage, 0) and got[2] == ("", 4)
    assert got[3] == (docs[2][1][len(passage) + 1 :], 4)
    parts = spans.sentences(passage)
    assert spans.runs(parts) == [(0, 2), (1, 3)] and spans.runs_to(parts)[::-1] == [(0, 2), (1, 3), (1, 4)]


def test_the_query_takes_tails(spark, tmp_path):
    text = " ".join(" ".join(f"{c}{i}" for i in range(n)) + "." for c, n in (("a", 12), ("b", 12), ("c", 5), ("d", 4)))
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect()) == [(1, text, 0), (2, "", 4)]


def test_short_repeats_go_and_so_do_passages(spark):
    """Passages among other words, whose sentences they break anywhere; and 19 words that texts share."""
    rng = random.Random(2)
    words = lambda n: [f"q{rng.randrange(900)}" for _ in range(n)]

    def prose(n):
        out = words(n)
        at = 0
        while at < n:
            at += rng.randint(3, 30)
            if at < n:
                out[at] += "."
        return out

    passages = [prose(rng.randint(51, 90)) for _ in range(60)]
    docs = [(i, " ".join(p)) for i, p in enumerate(passages)]
    for i, p in enumerate(passages):
        host = prose(150)
        at = rng.randrange(150)
        docs.append((100 + i, " ".join(host[:at] + p + host[at:])))
    short = "This is one sentence of ten words for the notice. And a second one has some nine words here."
    docs += [(200 + i, "Own words %d of this text are here. " % i + short + " Then it ends %d." % i) for i in range(30)]
    docs += [(300 + i, " ".join(prose(120))) for i in range(30)]
    got = {r.doc_id: r.n_removed for r in spans.without_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[100 + i] > 0 for i in range(60)) >= 57
    assert got[200] == 0 and all(got[200 + i] == 2 for i in range(1, 30))
    assert all(got[i] == 0 for i in got if i < 100 or i >= 300)


def test_two_sentences_of_two_documents(spark):
    text = " ".join(f"a{i}" for i in range(12)) + ". " + " ".join(f"b{i}" for i in range(12)) + "."
    docs = [(1, "x y. " + text), (2, "other start. " + text + " other end.")]
    got = {r.doc_id: r.text for r in spans.without_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "other start. other end."}


def test_an_own_column_n_removed_is_replaced(spark):
    text = "A first sentence of several words here. And a second one that adds many more words to it."
    df = spark.createDataFrame([(1, text, 70, 1), (2, text, 80, 2)], "doc_id long, text string, n_removed long, `a.b` int")
    out = spans.without_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, text, 1, 0), (2, "", 2, 2)]
    assert spans.without_repeated_spans(out.drop("a.b")).count() == 2


def test_very_long_text(spark):
    said = [f"Sentence number {i} has these eight words." for i in range(30_000)]
    docs = [(1, " ".join(said)), (2, " ".join(said[:15_000])), (3, "An own start here. " + " ".join(said[100:103]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.without_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("", 15_000), 3: ("An own start here. ", 3)}


def test_a_full_filter_loses_nothing(spark):
    every = spark.createDataFrame([(h,) for h in range(-50, 50)], "h1 long")
    twice = every.where("h1 % 5 = 0")
    assert {r.h1 for r in spans._sifted(every, twice, 64).collect()} >= {r.h1 for r in twice.collect()}
    assert {r.h1 for r in spans._sifted(every, twice).collect()} == {r.h1 for r in twice.collect()}
    assert spans._sifted(every, twice.limit(0)).count() == 0


def test_scripts_without_blanks(spark):
    passage = "这是一个在许多文件中重复出现的段落，它没有任何空格。第二句话也在这里，并且还有更多的文字，好让它足够长。第三句话结束这个段落吧！"
    docs = [(1, passage), (2, "开头不同。" + passage + "结尾也不同。"), (3, "完全不同的文字，只有一句。")]
    got = {r.doc_id: r.text for r in spans.without_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "开头不同。结尾也不同。", 3: docs[2][1]}
