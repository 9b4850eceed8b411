import random

from lamella.llm import lines, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs):
    """docs: (doc_id, text), ids distinct. The lines that go."""
    every = sorted(((-1 if d is None else d), j, line.lower().split()) for d, t in docs if t is not None for j, line in enumerate(t.split("\n")))
    gone = set()
    for k, (d, j, words) in enumerate(every):
        if not words:
            continue
        for _, _, other in every[:k]:
            long = [len(w) >= 8 for w in (words, other)]
            chars = [" ".join(w) for w in (words, other)]
            if other == words or all(long) and distance(words, other) <= 1 or not any(long) and min(map(len, chars)) >= 20 and distance(*chars) <= 1:
                gone.add((d, j))
                break
    return gone


def corpus():
    rng = random.Random(6)
    vocab = ["red", "blue", "Ärger", "x", "y", "z"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([2, 4, 7, 8, 9, 12]))] for _ in range(25)]
    docs = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(words))
                words[p : p + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocab)], ["new"]])
                words = words or ["x"]
            out.append(rng.choice([" ", "  "]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
        docs.append((d, "\n".join(out)))
    hot = "one very common line that many of the documents do share"
    docs += [(100 + i, f"{hot}\n{hot} number{i}\nown line {i} with w{i} v{i} u{i} t{i} s{i}") for i in range(40)]
    docs += [(200 + i, f"The colou{'r' * (i % 3)} of line\nzeichen{i % 4}ketteohneleerzeichen\n这是一行没有空格的文字，它有二十多个字符，第{i % 3}个版本") for i in range(12)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (None, hot + "\n\nand another line of this text here"), (303, "word " * 3000)]
    return docs


def test_helpers():
    a = "a b c d e f g h".split()
    assert lines.within_one_edit(a, a) and lines.within_one_edit(a, a[:3] + a[4:]) and lines.within_one_edit(a[1:], a)
    assert lines.within_one_edit(a, ["z", *a[1:]])
    assert lines.within_one_edit(a, a[:-1]) and not lines.within_one_edit(a, ["z", *a[2:]]) and not lines.within_one_edit(a, a[2:])
    assert not lines.within_one_edit(a, a[::-1])
    rng = random.Random(0)
    for _ in range(3000):
        x = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        y = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        assert lines.within_one_edit(x, y) == (distance(x, y) <= 1), (x, y)
        if distance(x, y) <= 1 and min(len(x), len(y)) > 1:
            for parts in (2, 8):
                a, b = ({k[1]: k for k in lines.part_keys(w, parts)} for w in (x, y))
                both = set(a) & set(b)
                assert both
                met = [{v[:2]: v[2] for v in lines.variants(w, {k[m][0] for m in both}, parts)} for w, k in ((x, a), (y, b))]
                roles = {(met[0][v], met[1][v]) for v in set(met[0]) & set(met[1])}
                assert x == y or roles & {(0, 0), (1, 2), (2, 1)}


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "l", 1, "k") for d, t in docs], "doc_id long, text string, line string, gone int, kept string")
    rows = lines.without_repeated_lines(df).collect()
    gone = brute(docs)
    want = {}
    for d, t in docs:
        k = -1 if d is None else d
        want[k] = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in gone)
    got = {(-1 if r.doc_id is None else r.doc_id): r.text for r in rows}
    assert got == want and len(rows) == len(docs)
    assert all(r.n_removed == sum(g[0] == (-1 if r.doc_id is None else r.doc_id) for g in gone) for r in rows)
    assert len(gone) > 80 and rows[0].line == "l"


def test_repeated_rows_and_empty(spark):
    text = "this line has quite enough words in it to count\nshort"
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = lines.without_repeated_lines(df).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, text), (1, text), (2, "")]
    assert lines.without_repeated_lines(df.limit(0)).count() == 0


def test_the_query_takes_short_lines(spark, tmp_path):
    """Exact repeats of lines of one to three words, and of lines without blanks; blank lines stay."""
    docs = [(1, "All rights reserved.\n\n这是一行没有空格的文字\nred"), (2, "ALL  rights reserved.\n\n这是一行没有空格的文字\nblue\n "), (3, "red")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, docs[0][1], 4, 0), (2, "\nblue\n ", 5, 2), (3, "", 1, 1)]


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    repeated = "a line that an earlier document has in the very same words"
    docs = [(1, repeated), (2, "first text here\n" + repeated), (2, "another text here\nUNIQUE line of a different document, nowhere else"), (None, "x"), (None, "y")]
    got = lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted([repeated, "first text here", docs[2][1], "x", "y"])


def test_very_long_lines(spark):
    word = "ab" * 4000
    docs = [(1, word), (2, word[:-1] + "c"), (3, "w " * 30000), (4, "w " * 29999 + "v")]
    got = lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_own_columns_of_the_results_names_are_replaced(spark):
    docs = [(1, "one two three\nfour five", 9, 8, "x", 1), (2, "One  two three\nsix", 9, 8, "y", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_removed long, N_Lines long, `a.b` string, gone int")
    out = lines.without_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "a.b", "gone", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, docs[0][1], "x", 1, 2, 0), (2, "six", "y", 2, 2, 1)]
    assert {r.doc_id: r.n_removed for r in lines.without_repeated_lines(out.drop("a.b")).select("doc_id", "n_removed").collect()} == {1: 0, 2: 0}
