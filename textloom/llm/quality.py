"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text becomes counts of hashed words and of word shapes (capitals, last character, digits, length, whether the word
repeats the one before), weighted by rarity. A truncated singular value decomposition of at most ``MOST_LABELLED``
labelled rows, chosen by a hash of their id, spans the latent space. Their vectors, at most ``MOST_LABELLED`` rows of
``RANK`` floats (under 2 MB), are broadcast; every document's cosines with all of them are computed as exact blocked
matrix products, and its ``NEIGHBOURS`` nearest vote with weights that grow with similarity.

Only rows whose crc32 of the id, as text, is not 2 modulo 4 are learnt from; labels, lang, source and ids never enter a
score.

Cases: a null, empty or blank text scores 0; ids that are null are not held out, and labels with null values or without
a document are left out; of several labels of an id the least counts, and of several texts of a labelled id
the one of the least features; without any usable label every score is 0.5 (0
for blank texts); repeated rows score alike; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels
from textloom.llm.texts import map_texts

#: Rows that the space and the votes are made from; accuracy no longer grows with more.
MOST_LABELLED = 6000
RANK = 64
NEIGHBOURS = 40
THRESHOLD = 0.7
_WORDS, _SHAPES = 2048, 512
SIZE = _WORDS + _SHAPES

_UPPER, _LETTER, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[0x41:0x5B] = 1
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = 1
_DIGIT[0x30:0x3A] = 1
_LAST = np.full(256, 7)
_LAST[_LETTER > 0] = _LAST[0x80:] = 0
for _k, _set in enumerate((b".", b",", b"!", b"?;:", b"*#$%&", b"|<>"), 1):
    _LAST[list(_set)] = _k


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped counts of words and shapes, a row of unit length for each part and text (zeros without words)."""
    n_rows = len(offsets) - 1
    starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
    row = kernels.row_of(first)
    hashes = kernels.span_hashes(kernels.LOWER[data], starts, ends)

    def within(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=total[1:])
        return total[ends] - total[starts]

    upper, letters, size = within(_UPPER), within(_LETTER), ends - starts
    head = _UPPER[data[starts]] if len(starts) else upper
    capitals = np.where(upper == 0, 0, np.where((upper == letters) & (letters > 1), 2, np.where((upper == 1) & (head == 1), 1, 3)))
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    last = _LAST[data[ends - 1]] if len(ends) else size
    shape = (((capitals * 8 + last) * 2 + (within(_DIGIT) > 0)) * 4 + np.searchsorted([2, 6, 12], size)) * 2 + again
    out = np.empty((n_rows, SIZE), np.float32)
    for low, high, term in ((0, _WORDS, (hashes % np.uint64(_WORDS)).astype(np.int64)), (_WORDS, SIZE, shape)):
        wide = high - low
        counts = np.sqrt(np.bincount(row * wide + term, minlength=n_rows * wide).reshape(n_rows, wide), dtype=np.float32)
        out[:, low:high] = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return out


class Votes:
    """The latent space with the labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        known = (rows > 0).sum(0)
        self.weights = np.log((1 + len(rows)) / (1 + known)).astype(np.float32) + 1
        self.weights[:_WORDS] *= 0.5
        x = rows * self.weights
        draw = np.random.Generator(np.random.PCG64(3)).standard_normal((SIZE, min(RANK + 16, len(rows)))).astype(np.float32)
        span = x @ draw
        for _ in range(3):
            span, _ = np.linalg.qr(span)
            span = x @ (x.T @ span)
        span, _ = np.linalg.qr(span)
        _, _, v = np.linalg.svd(span.T @ x, full_matrices=False)
        self.space = np.ascontiguousarray(v[:RANK].T * self.weights[:, None])
        self.vectors = np.ascontiguousarray(self.latent(rows).T)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = rows @ self.space
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty(len(rows))
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(rows), block):
            cosines = self.latent(rows[low : low + block]) @ self.vectors
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 16 + 1e-12
            out[low : low + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def _feature_bytes(data: np.ndarray, offsets: np.ndarray) -> list:
    return [pa.array([x.astype(np.float16).tobytes() for x in features(data, offsets)], pa.binary())]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Votes | None:
    """Learn from at most ``most`` labelled rows outside the held-out fold, the same ones at every run."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    made = map_texts(rows, _feature_bytes, "features binary", ["doc_id", "quality"]).selectExpr("row.doc_id", "row.quality", "features")
    # one row an id, the same one at every run, whatever rows repeat it
    table = made.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("x")).select("doc_id", "x.quality", "x.features").toArrow()
    if not len(table):
        return None
    table = table.sort_by("doc_id")
    rows = np.frombuffer(b"".join(table["features"].to_pylist()), np.float16).reshape(len(table), SIZE).astype(np.float32)
    marks = table["quality"].to_numpy().copy()
    del table
    votes = Votes(rows, marks)
    pa.default_memory_pool().release_unused()  # the driver keeps the votes alone
    return votes


def _kernel(broadcast):
    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        rows = features(data, offsets)
        votes = broadcast.value
        blank = ~rows.any(1)
        found = np.full(len(rows), 0.5) if votes is None else votes.scores(rows)
        return [np.where(blank, 0.0, np.clip(found, 0, 1))]

    return kernel


def score(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """``row`` (the columns of ``carry``) with score, in [0, 1], higher where label 1 is likelier."""
    votes = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    return map_texts(docs, _kernel(votes), "score double", carry)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, in the columns they came with."""
    scored = score(docs, labels).where(F.col("score") >= threshold)
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
