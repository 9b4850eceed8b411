"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import text_batches


BINS = 4096
#: Bytes that are no letters become blanks, A-Z are lower-cased, bytes of other scripts stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of category L is there; numbers such as ½, ² and ① are none."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Counts of hashed letter pairs and triples of the whole text as a unit vector (square roots tame frequent ones)."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass").translate(FOLD), dtype=np.uint8).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(257) + raw[2:]
    counts = np.zeros(BINS)
    for codes, salt in ((pairs, 40503), (triples, 2654435761)):
        mixed = (codes + np.uint32(1)) * np.uint32(salt | 1) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(20), minlength=BINS)
    counts[:] = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def codewords(n: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """``n`` words of +-1, far apart: of many seeded draws the one with the largest smallest distance.

    A bit that is the same for all languages tells nothing; it is turned for one of them.
    """
    rng = np.random.default_rng(seed)
    best, apart = np.ones((n, bits)), -1
    for _ in range(400):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        turned, one = np.abs(code.sum(axis=0)) == n, rng.integers(max(n, 1), size=bits)
        if n > 1:
            code[one[turned], np.flatnonzero(turned)] *= -1
        distances = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if n and distances.min() > apart:
            best, apart = code, distances.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the nearest two codewords are too close to tell."""
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0, True
        outputs = features(text) @ self.weights
        loss = (np.logaddexp(0, -4.0 * self.code * outputs) * self.bit_weight).sum(axis=1)
        odds = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, bool((odds > 0.9).sum() > 1)


def fit(languages: list[str], labels: np.ndarray, x: np.ndarray, ridge: float = 0.05) -> Model:
    """A ridge classifier per bit of the codewords; a bit weighs by how well it is told on the sample."""
    if not len(languages):
        return Model([], np.zeros((0, 0)), np.zeros((BINS, 0)), np.zeros(0))
    code = codewords(len(languages))
    y = code[labels].astype(np.float32)
    balance = 1.0 / np.bincount(labels, minlength=len(languages))[labels]
    root = np.sqrt(balance / balance.mean()).astype(np.float32)[:, None]
    kernel = (x * root) @ (x * root).T
    weights = (x * root).T @ np.linalg.solve(kernel.astype(np.float64) + ridge * np.eye(len(x)), y * root)
    right = (np.sign(x @ weights) == y).mean(axis=0)
    return Model(languages, code, weights.astype(np.float32), np.maximum(2 * right - 1, 0.01))


def _chosen_ids(usable: DataFrame, most_docs: int) -> list[tuple]:
    """(lang, doc_id) of up to ``most_docs`` labelled documents, as many of each language, by a hash of the id.

    Only ids under a hash threshold leave the tasks, however many tasks there are; the threshold of a language rises until
    enough are under it or all are.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)  # below 1 << 31
    ids = usable.select("lang", "doc_id", place.alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    each, found, share = max(1, most_docs // max(1, len(counts))), [], 1.5
    while counts:
        below = {name: min(1 << 31, int((1 << 31) * share * each / n) + 1) for name, n in counts.items()}
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
        under = ids.where(F.col("lang").isin(list(counts)) & (F.col("h") < limit)).distinct().collect()  # about share * most_docs rows
        by_lang: dict[str, list[tuple]] = {name: [] for name in counts}
        for r in under:
            by_lang[r["lang"]].append((r["h"], r["doc_id"]))
        for name in list(counts):
            if len(by_lang[name]) >= each or below[name] == 1 << 31:
                found += [(name, i) for _, i in sorted(by_lang[name])[:each]]
                del counts[name]
        share *= 4
    return found


def train(docs: DataFrame, most_docs: int = 1600) -> Model:
    """Fit on at most ``most_docs`` labelled documents, as many of each language, chosen by a hash of their ids.

    ``docs(doc_id, text, lang)`` holds what may be learned from. The sample is the only one in this module; a task, not
    the driver, gathers its features and fits. Documents without an id, a letter or a language are not used; of rows that
    share an id and a language, the one with the smallest text is.
    """
    spark = docs.sparkSession
    text_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    ids = _chosen_ids(usable, most_docs)
    if not ids:
        return fit([], np.zeros(0, dtype=int), np.zeros((0, BINS)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = F.broadcast(spark.createDataFrame(ids, f"lang string, doc_id {kind}"))  # at most most_docs rows
    chosen = usable.join(asked, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["lang"], r["x"]) for batch in batches for r in batch.to_pylist())
        languages = sorted({name for name, _ in rows})
        labels = np.array([languages.index(name) for name, _ in rows], dtype=int)
        x = np.array([np.frombuffer(x, "<f4") for _, x in rows], dtype=np.float32).reshape(-1, BINS)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(languages, labels, x))], pa.binary())], names=["model"])

    sample = chosen.select("lang", "text").mapInArrow(measured, "lang string, x binary")
    return pickle.loads(sample.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text)``.

    Whole texts are read. ``und`` with score 0 for a null text or one without a letter, and for every text if nothing was
    learned. ``ambiguous`` marks texts between two codewords. ``held_out``: crc32 of the id as text is 0 modulo 5; a null
    id counts as held out. Repeated rows and extra columns change nothing; an empty table gives an empty result.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "ambiguous"])

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return told.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, most_docs: int = 1600) -> DataFrame:
    """Train on the documents that are not held out and predict all of ``docs(doc_id, text, lang)``."""
    return predictions(docs, train(docs.where(~held_out("doc_id")), most_docs))


def keep_identified(docs: DataFrame, most_docs: int = 1600) -> DataFrame:
    """Rows of ``docs`` whose language the codes tell; a null ``lang`` is filled with it.

    Those predicted ``und`` go, and so do those between two codewords (``ambiguous``). All other values stay as they are.
    If no row has a language nothing can be learned, and only texts without a letter go.
    """
    model = train(docs.where(~held_out("doc_id")), most_docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lang_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            if model.languages:
                told = [model.predict(t.as_py()) for t in batch.column(at)]
                kept = [name != "und" and not ambiguous for name, _, ambiguous in told]
                names = [given if given is not None else t[0] for given, t in zip(batch.column(lang_at).to_pylist(), told)]
                batch = batch.set_column(lang_at, batch.schema.field(lang_at), pa.array(names, batch.schema.field(lang_at).type))
            else:
                kept = [t.is_valid and has_letter(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
