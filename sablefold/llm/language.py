"""Language identification by a string kernel: Nystroem landmarks and one-versus-rest ridge regression.

A text's set of character n-grams (n = 1 to 4, lower case, runs of white space as one space) is
hashed to ``BITS`` presence bits, a blended spectrum. The kernel of two texts is the size of the
common set over the geometric mean of both sizes. Landmarks are a sample of training texts; the
features K(x, landmarks) K(landmarks, landmarks)^(-1/2) feed ridge regressions, one for each language
against the rest. Landmarks and regressions fold into one matrix, so a batch is scored by two matrix
products: presence by landmarks, kernel by classes.

The fit uses at most ``FIT_ROWS`` labelled texts (or one of each language, if those are more), as many of
each language, chosen by a hash of id and text over all labelled rows; each comes to the driver as its ``BITS`` / 8 bytes of presence bits, so the
fit's memory has a fixed bound. Prediction streams whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table

BITS = 1 << 14
GRAMS = 4
#: Labelled texts in the fit (one of each language at least), and landmarks among them.
FIT_ROWS = 3_000
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def presence(text: str) -> np.ndarray:
    """The text's n-gram set as BITS zeros and ones."""
    out = np.zeros(BITS, np.uint8)
    points = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - (BITS.bit_length() - 1))
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + (points[n - 1 :] + np.uint64(1)) * _MULTIPLIERS[n - 1]
        mixed = (rolled ^ (rolled >> np.uint64(29))) * _MULTIPLIERS[0]
        out[(mixed >> shift).astype(np.int64)] = 1
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Languages, landmark bits (packed) and sizes, and the matrix from kernel values to class margins."""

    langs: tuple[str, ...]
    bits: bytes
    weights: np.ndarray

    def landmarks(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.bits, np.uint8)).reshape(-1, BITS)

    def scores(self, bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return kernel(bits, marks) @ self.weights[:-1] + self.weights[-1:]

    def predict(self, texts: list[str | None], marks: np.ndarray) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        real = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for i in range(0, len(real), 256):
            part = real[i : i + 256]
            margins = self.scores(np.stack([presence(texts[j]) for j in part]), marks)
            best = margins.argmax(axis=1)
            score = np.clip((margins[np.arange(len(part)), best] + 1) / 2, 0.0, 1.0)
            for j, b, s in zip(part, best, score, strict=True):
                out[j] = (self.langs[b], float(s))
        return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of rows of bits; counts are exact in float32."""
    left, right = a.astype(np.float32), b.astype(np.float32)
    sizes = np.sqrt(np.maximum(left.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(right.sum(axis=1), 1))[None, :]
    return (left @ right.T / sizes).astype(np.float64)


def fit_bits(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of rows of presence bits; rows come in a fixed order, landmarks evenly out of them."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), b"", np.zeros((0, 0)))
    marks = bits[np.unique(np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int))]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, target = np.zeros((keep.sum() + 1,) * 2), np.zeros((keep.sum() + 1, len(names)))
    count = np.array([langs.count(n) for n in names], float)
    place = {n: i for i, n in enumerate(names)}
    for i in range(0, len(bits), 512):
        z = kernel(bits[i : i + 512], marks) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        own = np.array([place[x] for x in langs[i : i + 512]])
        y = np.where(own[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
        share = (1 / count[own])[:, None]  # languages weigh alike
        gram += z.T @ (z * share)
        target += z.T @ (y * share)
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), target)
    # the last row is the constant
    return Model(names, np.packbits(marks).tobytes(), np.vstack([root @ solved[:-1], solved[-1:]]))


def _chosen(labelled: DataFrame, rows: int) -> list[tuple[str, int, bytes]]:
    """(lang, hash, packed bits) of at most ``rows`` texts, as many of each language as there are."""
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return []
    each = max(1, rows // len(counts))
    # the share of a language's hashes that holds about ``each`` of its rows, with room for chance
    shares = {lang: min(1.0, (each + 4 * each**0.5 + 8) / n) for lang, n in counts}
    mark = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))
    limit = F.create_map(*[x for lang, s in shares.items() for x in (F.lit(lang), F.lit(s * 2**32))])
    picked = labelled.withColumn("mark", mark).filter(F.col("mark") < F.element_at(limit, F.col("lang"))).select("lang", "mark", "text")
    # repeated rows share a hash: ranks keep the bound, and each task sends no more than it allows
    first = Window.partitionBy("lang").orderBy("mark", "text")
    picked = picked.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= each).drop("at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence(t or "")).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["lang", "mark", "bits"])

    got = [(r[0], r[1], bytes(r[2])) for r in picked.mapInArrow(pack, "lang string, mark bigint, bits binary").collect()]
    return sorted(got, key=lambda r: (r[1], r[0], r[2]))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows of ``docs`` (doc_id, text, lang) that held_out() leaves. Rows without
    text, letters or language teach nothing; without any the model knows no language. Every label is learned."""
    labelled = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    picked = _chosen(labelled, rows)
    if not picked:
        return fit_bits(np.zeros((0, BITS), np.uint8), [])
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in picked), np.uint8)).reshape(-1, BITS)
    return fit_bits(bits, [r[0] for r in picked])


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of its text and a score from 0 to 1; only the text is
    looked at. Null texts and texts without a letter are ``und`` with score 0, as all are to a model
    without languages. Columns of ``docs`` named like the new ones are replaced."""
    docs = docs.drop(lang, score)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS * BITS / 8 bytes and the weights
    at = docs.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{lang}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        marks = own.landmarks().astype(np.float32) if own.langs else np.zeros((0, BITS), np.float32)
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                got = own.predict(batch.column(at).to_pylist(), marks)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, lang, score])
        del own, marks
        give_back()

    return docs.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
