"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import broadcast_if_small, components, cut, sliced, stored, text_batches

SEED = 42
#: So many shared grid cells of 8 bytes are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 1_000_000
#: So many digests of texts of 32 characters are broadcast; more are joined by shuffle.
BROADCAST_NODES = 200_000
#: Of the classes that a text's shingles are dealt into, so many get a fingerprint.
CLASSES = 16


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the shingles of whitespace words, repeats included, A-Z lower-cased; of fewer words, of them all; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a whole text; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs(doc_id, text)``, ``fp`` as a signed long; a null text has fingerprint 0."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], names=["doc_id", "fp"])

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of_batches, f"doc_id {kind}, fp bigint")


def popcounts(prints: np.ndarray, segments: int) -> np.ndarray:
    """Embedding of 64-bit fingerprints: the number of ones in each of ``segments`` equal runs of bits, low bits first."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(prints), segments, 64 // segments).sum(axis=2, dtype=np.uint64)


def grid_cells(prints: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): numbers of the grid cell of each embedding and of all cells at Manhattan distance 1 from it.

    Two embeddings at Manhattan distance 2 or less share one of these cells (either's own, or a point half-way), and the
    Manhattan distance of popcounts never exceeds the Hamming distance. So no pair within 2 bits is missed. With 64
    segments of one bit a cell is a fingerprint.
    """
    width = 64 // segments
    base = np.uint64(width + 1)
    powers = np.cumprod(np.array([1, *[int(base)] * (segments - 1)], dtype=np.uint64))
    counts = popcounts(prints, segments)
    own = (counts * powers).sum(axis=1, dtype=np.uint64)
    up, down = np.nonzero(counts < width), np.nonzero(counts > 0)
    rows = np.concatenate([np.arange(len(prints)), up[0], down[0]])
    return rows, np.concatenate([own, own[up[0]] + powers[up[1]], own[down[0]] - powers[down[1]]])


def in_cells(prints: DataFrame, segments: int) -> DataFrame:
    """``(fp, cell)`` for the distinct ``prints(fp)``: their own grid cells and those next to them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            own = batch.column(0).to_numpy()
            if segments == 64:
                flips = np.array([0, *(1 << i for i in range(64))], dtype="<u8")
                rows, cells = np.repeat(np.arange(len(own)), 65), (own.view("<u8")[:, None] ^ flips).ravel()
            else:
                rows, cells = grid_cells(own.view("<u8"), segments)
            yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(cells.view("<i8"))], names=["fp", "cell"])

    # Few bytes become many rows here: dealt by another expression than the distinct above, so that Spark neither leaves
    # this exchange out nor merges its partitions by their size.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").distinct().repartition(parts, F.xxhash64("fp")).mapInArrow(emit, "fp bigint, cell bigint")


def links(prints: DataFrame, segments: int = 32) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints of ``prints(fp)`` lying within 2 bits of each other.

    First the grid of ``segments`` popcounts: a fingerprint alone in all its cells has no partner and leaves. Then the same
    embedding on the finest grid, 64 segments of one bit, where Manhattan distance *is* Hamming distance. A finest cell has
    at most 65 members, each within one bit of it, so linking each to the smallest is bounded work however large a group of
    near copies is, and no pairs of a group are listed. The bits of every link are counted at the end.
    """
    cells = in_cells(prints, segments)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    shared = broadcast_if_small(cut(shared), BROADCAST_CELLS)
    close = cut(cells.join(shared, "cell", "left_semi").select("fp").distinct())
    root = F.min("fp").over(Window.partitionBy("cell"))
    edges = in_cells(close, 64).select(F.col("fp").alias("a"), root.alias("b")).where("a <> b").distinct()
    return edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, shingle: int = 3, segments: int = 32) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    Fingerprints within 2 bits are linked, and ``component_id`` is the smallest doc_id reachable over links. Equal
    fingerprints are one class, so copies are never paired. Null or word-less texts have fingerprint zero and are linked
    like any other. Repeated rows come back as often as they came in; a null doc_id keeps its row and never names a
    component unless all ids there are null. An empty table gives an empty result.
    """
    own = cut(fingerprints(docs, shingle))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(classes, segments))
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.join(named, "component").select("fp", "component_id")
    return own.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _level(n: float) -> int:
    """Classes of 3 to 6 shingles, of half as many where a text has few: one word changes several shingles of them."""
    return max(0, int(np.floor(np.log2(n / 3))) + (n < 48)) if n >= 3 else 0


def segment_prints(hashes: np.ndarray, similarity: float = 0.8, classes: int = CLASSES) -> np.ndarray:
    """A key for each fingerprint of distinct shingles dealt by hash into 2^level classes, the first ``classes`` of them.

    A key is the SimHash of a class mixed with its level and number. Similar texts have equal shingles in many classes, so
    some of the classes' SimHashes are equal, whatever the length of the texts; unrelated texts share none. Texts whose
    numbers of shingles differ as much as ``similarity`` allows may stand on either side of a step of the level: such get
    the keys of both levels.
    """
    keys, n = [], len(hashes)
    spread = hashes * np.uint64(0x9E3779B97F4A7C15)  # the class must not depend on bits of the fingerprint alone
    for level in {_level(m) for m in (n * similarity, n, n / similarity)} if n else ():
        of = spread >> np.uint64(64 - level) if level else np.zeros(n, dtype="<u8")
        near = np.flatnonzero(of < classes)
        if not len(near):
            continue
        near = near[np.argsort(of[near], kind="stable")]
        starts = np.flatnonzero(np.diff(of[near], prepend=np.uint64(classes)))
        bits = np.unpackbits(hashes[near].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        most = 2 * ones > np.diff(starts, append=len(near))[:, None]
        prints = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        salt = (of[near][starts] + np.uint64(level * classes + 1)) * np.uint64(0xD6E8FEB86659FD93)
        keys.append((prints ^ (salt ^ salt >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD))
    return np.concatenate(keys) if keys else np.zeros(0, dtype="<u8")


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, segments: int = 32) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``docs(node, text)`` whose sets of shingles have at least that Jaccard similarity.

    The edges connect exactly the groups that all such pairs connect: those that fingerprints find (see ``fingerprint_links``),
    and the pairs left between the components of these (see ``rest_links``).
    """
    close = stored(fingerprint_links(docs, shingle, similarity, segments), "simhash-links")
    return close.unionByName(rest_links(docs, components(close), shingle, similarity))


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least of some distinct hashes, so many that two sets of that similarity share one of them.

    Of n hashes a set of that similarity holds at least ``similarity`` * n; if the least of all shared ones were beyond the first
    n - ceil(similarity * n) + 1 of either set, there would be fewer.
    """
    return np.sort(hashes)[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1] if len(hashes) else hashes


def rest_links(docs: DataFrame, found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` between all nodes of that similarity that stand in different components of ``found(node, component)``.

    Nodes share a hash of their prefixes (see ``prefix``). The hashes alone are counted first, by the numbers of components; those of
    several components, of which there are few, are taken again with nodes, sizes and places. Two sets share the hashes that their
    prefixes share and at most all that stand beyond the prefix that ends first; pairs go on if these are as many as the similarity asks
    for, and so if those from the first shared one on are. They are verified on their whole texts.
    """
    kind = docs.schema["node"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            hashes = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            own = [prefix(h, similarity) for h in hashes]
            many = np.array([len(o) for o in own], dtype=np.int64)
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), many)))
            cells = np.concatenate([np.zeros(0, dtype="<u8"), *own]).view("<i8")
            sizes = np.repeat(np.array([len(h) for h in hashes], dtype=np.int32), many)
            places = np.concatenate([np.zeros(0, dtype=np.int32), *[np.arange(m, dtype=np.int32) for m in many]])
            yield pa.RecordBatch.from_arrays([nodes, pa.array(cells), pa.array(sizes), pa.array(places)], names=["node", "cell", "n", "at"])

    component = found.select(F.col("node"), F.xxhash64("component").alias("class")).distinct()
    component = broadcast_if_small(cut(component), BROADCAST_CELLS)

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(component, "node", "left").withColumn("class", F.coalesce("class", F.xxhash64("node")))

    emitted = docs.select("node", "text").mapInArrow(emit, f"node {kind}, cell bigint, n int, at int")
    shared = classed(emitted.select("node", "cell")).groupBy("cell").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("cell")
    kept = stored(classed(emitted.join(broadcast_if_small(cut(shared), BROADCAST_CELLS), "cell", "left_semi")).distinct(), "simhash-prefixes")
    one, two = (kept.withColumnsRenamed({"node": x, "class": f"{x}_class", "n": f"{x}_n", "at": f"{x}_at"}) for x in "ab")
    near = (F.col("a_n") >= F.col("b_n") * similarity - 1e-6) & (F.col("b_n") >= F.col("a_n") * similarity - 1e-6)
    met = one.join(two, "cell").where((F.col("a_class") < F.col("b_class")) & near)
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    each = met.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("c"), F.max(left).alias("left"))
    asked = F.lit(similarity / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) - 1e-6
    beyond = F.ceil(F.greatest("a_n", "b_n") * similarity - 1e-9) - 1
    pairs = each.where((F.col("left") >= asked) & (F.col("c") + beyond >= asked)).select("a", "b")
    return verified(docs, stored(pairs, "simhash-rest"), shingle, similarity)


def fingerprint_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, segments: int = 32) -> DataFrame:
    """Edges ``(a, b)`` of ``similar_links`` that fingerprints find.

    Rows of one node have one text. Whole-text fingerprints meet on the grid of segment popcounts, within 2 bits (see
    ``links``); texts of 0.8 mostly lie farther apart, so candidates also share a fingerprint of a class of shingles (see
    ``segment_prints``). Of a shared fingerprint
    every member is held against the smallest one, and so it is within the members whose whole-text fingerprints begin
    alike: work is linear in a group's size. All candidates are verified on their whole texts.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            at, keys, places = [], [], []
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), shingle)
                place = np.array([majority(hashes)], dtype="<u8").view("<i8")[0]
                own = segment_prints(np.unique(hashes), similarity)
                at.append(np.full(len(own), i)), keys.append(own), places.append(np.full(len(own), place))
            columns = [np.concatenate(c) if c else np.zeros(0) for c in (at, keys, places)]
            nodes = batch.column(0).take(pa.array(columns[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(columns[1].astype("<u8").view("<i8")), pa.array(columns[2].astype("<i8"))], names=["node", "cell", "fp"])

    kind = docs.schema["node"].dataType.simpleString()
    cells = stored(docs.select("node", "text").mapInArrow(emit, f"node {kind}, cell bigint, fp bigint").distinct(), "simhash-classes")
    # Aggregates are stored before they are joined, so that both sides are dealt anew and a hot group can be split.
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    high = F.shiftrightunsigned("fp", 56)
    split = F.array(F.xxhash64("cell"), F.xxhash64("cell", high), F.xxhash64("cell", F.shiftrightunsigned("fp", 48).bitwiseAND(F.lit(255)), F.lit(1)))
    by_class = cells.join(broadcast_if_small(shared, BROADCAST_CELLS), "cell", "left_semi").select("node", F.explode(split).alias("key"))
    whole = cut(cells.select("node", "fp").distinct())
    near = cut(links(whole, segments))
    ends = near.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("key"))
    alike = whole.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", F.xxhash64("fp", F.lit("alike")).alias("key"))
    by_grid = whole.join(ends.unionByName(alike), "fp").select("node", "key")
    keyed = stored(by_class.unionByName(by_grid), "simhash-shared")
    least = stored(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-least")
    pairs = stored(keyed.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "simhash-candidates")

    return verified(docs, pairs, shingle, similarity)


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of nodes of ``docs(node, text)`` whose whole texts have that similarity."""
    kind = docs.schema["node"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets: dict[str, np.ndarray] = {}
            kept = []
            for texts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = (sets[t] if t in sets else sets.setdefault(t, np.unique(shingle_hashes(t, shingle))) for t in texts)
                both = len(np.intersect1d(one, two, assume_unique=True))
                kept.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    sought = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = docs.join(broadcast_if_small(sought, BROADCAST_NODES), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    texts = stored(texts, "simhash-texts")
    two = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}), "b")
    return two.select("a", "b", "a_text", "b_text").mapInArrow(verify, f"a {kind}, b {kind}")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that stay: one of every group of near copies, the one with the smallest doc_id.

    Groups are connected components over texts of that ``similarity`` (see ``similar_links``). Equal texts are one node,
    whatever their ids; a null text is an empty one, and texts without words are alike. Rows that share a doc_id are judged
    by their own texts. Null ids come first in order. Of rows equal in id and text one stays. Other columns pass through;
    an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    node = F.unhex(F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")))
    rank = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    place = F.struct("doc_id", rank.alias("rank"))
    nodes = docs.select(node.alias("node"), text.alias("text"))
    found = cut(components(fingerprint_links(nodes, shingle, similarity)))
    rest = cut(rest_links(nodes, found, shingle, similarity))
    if not rest.isEmpty():
        found = cut(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)))
    firsts = docs.select(node.alias("node"), place.alias("first")).groupBy("node").agg(F.min("first").alias("first"))
    placed = firsts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min(F.struct("first", "node")).alias("best"))
    best = stored(best.select(F.col("best.node").alias("_node"), F.col("best.first").alias("_first")), "simhash-kept")
    keyed = docs.select(F.struct("*").alias("_row"), node.alias("_own"), place.alias("_place"))
    return keyed.join(best, F.expr("_own = _node AND _place <=> _first")).dropDuplicates(["_own"]).select("_row.*")
