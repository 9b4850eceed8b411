"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import ascii_lower, broadcast_if_small, cut

#: Runs of these characters separate words; letters are lower-cased only where words are compared.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A benchmark vocabulary of at most so many terms (and as many windows) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text in their own case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """``(phrase, size, items)``: the distinct windows of ``width`` words, an item of fewer words being one window."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
    return (
        benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("start"))
        .select("item_id", F.slice("w", F.col("start"), width).alias("w"))
        .groupBy(F.concat_ws(" ", "w").alias("phrase"))
        .agg(F.first(F.size("w")).alias("size"), F.collect_set("item_id").alias("items"))
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """One row a document, keyed by id and text so that rows sharing an id stay apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each of ``terms(term)``."""
    every = _tokens(docs).select(F.explode("w").alias("word")).select(F.lower("word").alias("term"))
    return every.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(phrases: DataFrame, counts: DataFrame, anchors: int = 2) -> DataFrame:
    """``(phrase, size, lead, also)``: for each window its rarest term and the next rarest, as (n, offset, term).

    A window with a term the corpus lacks cannot occur and leaves. A window of one word has no ``also``.
    """
    each = phrases.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    ranked = (
        each.withColumn("term", F.lower("word"))
        .join(counts, "term")
        .groupBy("phrase", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
        .where(F.size("terms") == F.col("size"))
    )
    return ranked.select("phrase", "size", F.get("terms", F.lit(0)).alias("lead"), F.get("terms", F.lit(anchors - 1)).alias("also"))


def postings(docs: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    """Positional postings of ``terms``: (term, doc_id, text_key, position, before, context).

    ``context`` is the posting's neighbourhood of ``width`` - 1 words on either side, A-Z lower-cased, and ``before`` the
    number of its words that precede the posting: enough to check any window over the posting without the document.
    """
    before = F.least(F.col("position"), F.lit(width - 1))
    around = F.slice("w", F.col("position") - before + 1, before + width)
    return (
        _tokens(docs)
        .select("doc_id", "text_key", "w", F.posexplode("w").alias("position", "word"))
        .withColumn("term", F.lower("word"))
        .join(terms, "term")
        .select("term", "doc_id", "text_key", "position", before.alias("before"), ascii_lower(F.concat_ws(" ", around)).alias("context"))
    )


def exact_matches(docs: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """Occurrences ``(doc_id, text_key, start, size, phrase)`` of the windows in the documents.

    Lists of the two rarest terms of a window are shifted by the terms' offsets and intersected; what is left is compared
    word by word with the context stored in the posting.
    """
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("word")).select(F.lower("word").alias("term")).distinct()
    counts = term_counts(docs, broadcast_if_small(vocabulary, BROADCAST_ROWS))
    chosen = cut(rarest_terms(phrases, counts))
    rare = chosen.select(F.col("lead.term").alias("term")).union(chosen.where("also IS NOT NULL").select("also.term")).distinct()
    index = cut(postings(docs, broadcast_if_small(rare, BROADCAST_ROWS), width))

    def shifted(which: str) -> DataFrame:
        asked = chosen.where(f"{which} IS NOT NULL").select("phrase", "size", "also", F.col(f"{which}.term").alias("term"), F.col(f"{which}.offset").alias("offset"))
        return index.join(broadcast_if_small(asked, BROADCAST_ROWS), "term").withColumn("start", F.col("position") - F.col("offset"))

    spelled = F.concat_ws(" ", F.slice(F.split("context", " "), F.greatest(F.col("before") - F.col("offset") + 1, F.lit(1)), F.col("size")))
    lead = shifted("lead").where("before >= offset").where(spelled == F.col("phrase"))
    lead = lead.select("doc_id", "text_key", "start", "size", "phrase", F.col("also").isNotNull().alias("paired"))
    other = shifted("also").where("before >= offset").select("doc_id", "text_key", "start", "phrase").distinct()
    same = "l.doc_id <=> o.doc_id AND l.text_key = o.text_key AND l.start = o.start AND l.phrase = o.phrase"
    met = lead.where("paired").alias("l").join(other.alias("o"), F.expr(same), "left_semi")
    return met.unionByName(lead.where("NOT paired")).drop("paired").distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, slop: int = 13) -> DataFrame:
    """``(doc_id, item_id)`` where the two rarest terms of a window of the item lie within ``slop`` words of each other.

    A looser test than an exact phrase: inserted, dropped or reordered words between the terms do not matter.
    """
    phrases = cut(windows(benchmark, width))
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("word")).select(F.lower("word").alias("term")).distinct()
    chosen = cut(rarest_terms(phrases, term_counts(docs, broadcast_if_small(vocabulary, BROADCAST_ROWS))).where("also IS NOT NULL"))
    pairs = chosen.select("phrase", F.col("lead.term").alias("t1"), F.col("also.term").alias("t2"))
    rare = pairs.select(F.col("t1").alias("term")).union(pairs.select("t2")).distinct()
    index = cut(postings(docs, broadcast_if_small(rare, BROADCAST_ROWS), width).drop("context", "before"))
    # Both positions fall in the same or in neighbouring blocks of ``slop`` words: an equi-join on the block, no band join.
    one = pairs.join(index.withColumnRenamed("term", "t1").withColumnRenamed("position", "p1"), "t1")
    one = one.withColumn("block", F.explode(F.array(*[F.floor(F.col("p1") / slop) + d for d in (-1, 0, 1)])))
    two = index.select(F.col("term").alias("t2"), F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key"), F.col("position").alias("p2"), F.floor(F.col("position") / slop).alias("block"))
    near = one.join(two, ["t2", "block"]).where("doc_id <=> other_id AND text_key = other_key AND abs(p1 - p2) <= " + str(int(slop)) + " AND p1 <> p2")
    held = near.select("doc_id", "phrase").distinct().join(phrases.select("phrase", "items"), "phrase")
    return held.select("doc_id", F.explode("items").alias("item_id")).distinct()


def judged(docs: DataFrame, benchmark: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a benchmark window of ``width`` words; ``n_items`` counts items with occurring
    windows and ``items_sha256`` digests their ids, sorted as strings. Contaminated: some hit, and hits are at least
    one in ``one_in`` of the words. Null or empty texts have no words and are clean; rows that share a doc_id are judged by their
    own text; repeated rows come back as often as they came in. Items without words match nothing. Columns other than
    doc_id, text and item_id, text are ignored. An empty table on either side gives no hits.
    """
    phrases = cut(windows(benchmark, width))
    found = cut(exact_matches(docs, phrases, width))
    key = ["doc_id", "text_key"]
    earlier = Window.partitionBy(*key).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(earlier), F.lit(0))
    hits = (
        found.select(*key, "start", "size")
        .distinct()
        .select(*key, F.greatest(end - F.greatest("start", reached), F.lit(0)).alias("fresh"))
        .groupBy(*key)
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )
    named = (
        found.select(*key, "phrase")
        .distinct()
        .join(broadcast_if_small(phrases.select("phrase", F.explode(F.col("items").cast("array<string>")).alias("item")), BROADCAST_ROWS), "phrase")
        .select(*key, "item")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    sized = _tokens(docs).select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    marks = hits.alias("h").join(named.alias("n"), F.expr("h.doc_id <=> n.doc_id AND h.text_key = n.text_key"), "left").select("h.*", "n.items")
    joined = sized.alias("d").join(marks.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.text_key = m.text_key"), "left")
    n_hit = F.coalesce("m.n_hit", F.lit(0).cast("long"))
    items = F.coalesce("m.items", F.array().cast("array<string>"))
    return joined.select(
        "d.doc_id",
        "d.text_key",
        "d.n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("d.n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """``judged`` without the digest of the text."""
    return judged(docs, benchmark, width, one_in).drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """Rows of ``docs`` that are not contaminated (see ``judged``); rows that share a doc_id go or stay by their own text.

    All columns pass through; an empty table gives an empty result.
    """
    bad = judged(docs, benchmark, width, one_in).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_key")).distinct()
    kept = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("text_key"))
    return kept.join(bad, F.expr("doc_id <=> _bad AND text_key = _key"), "left_anti").select("_row.*")
