"""Ranked lexical search by a blocked product of sparse matrices.

Items are rows of term multiplicities, documents are columns of integer impacts. One pass over the texts notes for each
document how many terms it has and how often each term of the items occurs; that is written once, and all else works on
it. A second pass sums document frequencies, one row a term and task. In the third, every block of documents becomes a
matrix by terms, whose rows are merged for each item as Gustavson does: the impacts of each of the item's terms, times
its multiplicity, are added into one dense row of 64-bit integers. A task keeps the best documents of each item from
block to block, so it gives at most ``top`` rows an item, and a window takes the best of those.

Items are taken in blocks of about ``MOST_BYTES`` of text, each a job of its own, so what is broadcast (their terms'
hashes and weights) and what a task holds never grow with the benchmark; one longer item is a block of its own. Terms
are told apart by hashes of 64 bits.

Cases: null texts, empty ones and those without a term have no terms, are not counted and never found; items without a
term find nothing; repeated items are one, items that share an id are ranked apart; repeated documents are ranked each,
of equal scores and ids in any order; a null doc_id comes after all others; without documents or items the result is
empty; other columns never clash, as only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm import kernels
from textloom.llm.storage import dropped, saved
from textloom.llm.texts import map_texts, named

TOP = 20
#: Text of the items of one block.
MOST_BYTES = 4 << 20
#: The share of length in a term's saturation, in hundredths, and the saturation's scale.
LENGTH_SHARE, SATURATION = 25, 12
SCALE = 1_000_000_000


class Items:
    """The items of a block as a sparse matrix: terms and multiplicities, row after row."""

    def __init__(self, texts: list[str | None]) -> None:
        data, offsets = kernels.buffers(pa.array(texts, pa.large_string()))
        data = kernels.LOWER[data]
        starts, ends, first = kernels.words(data, offsets, kernels.LETTERED)
        self.vocabulary, term = np.unique(kernels.span_hashes(data, starts, ends), return_inverse=True)
        size = max(1, len(self.vocabulary))
        cell, times = np.unique(kernels.row_of(first) * size + term, return_counts=True)
        self.term, self.times = cell % size, times.astype(np.int64)
        self.first = np.searchsorted(cell, np.arange(len(texts) + 1) * size)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.vocabulary & np.uint64((1 << 20) - 1)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some words are terms of the items, and which terms they are."""
        some = np.flatnonzero(self.near[hashes & np.uint64((1 << 20) - 1)])
        if not len(self.vocabulary):
            return some, some
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[some]
        return some[same], at[same]


def postings(docs: DataFrame, items) -> DataFrame:
    """doc_id, size (terms with repeats) and, of the terms of a broadcast block of items, which occur and how often."""

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        data = kernels.LOWER[data]
        starts, ends, first = kernels.words(data, offsets, kernels.LETTERED)
        some, term = items.value.places(kernels.span_hashes(data, starts, ends))
        size = max(1, len(items.value.vocabulary))
        cell, times = np.unique(kernels.row_of(first)[some] * size + term, return_counts=True)
        at = np.searchsorted(cell, np.arange(len(offsets)) * size).astype(np.int32)
        return [np.diff(first), pa.ListArray.from_arrays(at, (cell % size).astype(np.int32)), pa.ListArray.from_arrays(at, times.astype(np.int32))]

    out = map_texts(docs, kernel, "size long, terms array<int>, times array<int>", ["doc_id"])
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "size", "terms", "times")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of an Arrow list column without nulls."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """How many documents have a term, how many terms they have in all, and how many documents have each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = np.zeros(n_terms, np.int64), [0, 0]
        for batch in batches:
            size = batch.column(0).to_numpy()
            total = [total[0] + int((size > 0).sum()), total[1] + int(size.sum())]
            have += np.bincount(_lists(batch.column(1))[0], minlength=n_terms)
        term = np.flatnonzero(have)
        yield pa.record_batch([pa.array([-2, -1, *term], pa.int64()), pa.array([*total, *have[term]], pa.int64())], names=["term", "n"])

    summed = found.select("size", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    have, total = np.zeros(n_terms, np.int64), {}
    for term, n in summed.collect():  # a row for each of the block's terms at most
        if term < 0:
            total[term] = n
        else:
            have[term] = n
    return total.get(-2, 0), total.get(-1, 0), have


def impacts(size: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each occurring term of a document adds to the score of an item that has it once."""
    most = int(size.max(initial=0)) * LENGTH_SHARE * n
    wide = size.astype(object) if most >= 1 << 63 else size
    length = (100 - LENGTH_SHARE + (LENGTH_SHARE * n * wide) // total).astype(np.int64)
    return weights[term] * ((SCALE * times) // (1000 * times + SATURATION * length[row]))


def _best(scores: np.ndarray, empty: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by ascending id, null ids last."""
    at = np.arange(len(scores))
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], empty[at], -scores[at]))][:top]


def products(found: DataFrame, items, weights, n: int, total: int, top: int) -> DataFrame:
    """item (its row in the block), doc_id and score of the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = items.value, weights.value
        n_items, n_terms = len(block.first) - 1, len(weight)
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items
        for batch in batches:
            term, first = _lists(batch.column(2))
            row, times, size = kernels.row_of(first), _lists(batch.column(3))[0].astype(np.int64), batch.column(1).to_numpy()
            value = impacts(size, row, term, times, weight, n, total)
            order = np.argsort(term, kind="stable")
            row, value, starts = row[order], value[order], np.searchsorted(term[order], np.arange(n_terms + 1)).tolist()
            empty = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for k in range(n_items):
                scores = np.zeros(batch.num_rows, np.int64)
                cells = slice(block.first[k], block.first[k + 1])
                for t, m in zip(block.term[cells].tolist(), block.times[cells].tolist(), strict=True):
                    a, b = starts[t], starts[t + 1]
                    if a < b:
                        scores[row[a:b]] += m * value[a:b]  # a document has a term once
                old = best[k]
                at = np.flatnonzero(scores > (old[0][-1] - 1 if len(old[0]) == top else 0))
                if len(at):
                    both = [np.concatenate(x) for x in zip(old, (scores[at], empty[at], ids[at]), strict=True)]
                    at = _best(*both, top)
                    best[k] = tuple(x[at] for x in both)
        item = np.repeat(np.arange(n_items), [len(x[0]) for x in best])
        if len(item):
            scores, empty, ids = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=empty), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple]]:
    """Distinct items, some of ``most_bytes`` together, by a hash of their id and text."""
    items = benchmark.select(named("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield [tuple(r) for r in rows]


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item, of all documents."""
    spark = docs.sparkSession
    rows = docs.select(named("doc_id").cast("long").alias("doc_id"), named("text").alias("text"))
    kind = benchmark.schema["item_id"].dataType
    parts = []
    for block in blocks(benchmark, most_bytes):
        items = spark.sparkContext.broadcast(Items([text for _, text in block]))
        n_terms = len(items.value.vocabulary)
        if not n_terms:
            continue
        found = saved(postings(rows, items), "postings")
        n, total, have = statistics(found, n_terms)
        if total:
            weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in have], np.int64)
            best = products(found, items, spark.sparkContext.broadcast(weights), n, total, top)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            parts.append(saved(_with_ids(best, [x[0] for x in block], kind), "ranked"))  # so postings are done with
        dropped(found)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _ranked(kind))


def _ranked(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("rank int, doc_id long, score long")])


def _with_ids(best: DataFrame, ids: list, kind: T.DataType) -> DataFrame:
    """The items' own ids in place of their rows in a block."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(ids, arrow)
        for batch in batches:
            yield pa.record_batch([own.take(batch.column(0)), *batch.columns[1:]], names=["item_id", "rank", "doc_id", "score"])

    return best.select("item", "rank", "doc_id", "score").mapInArrow(run, _ranked(kind))


#: The same of documents and items with unique ids, in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
i AS (
  SELECT item_id, t, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM d) SEMI JOIN (SELECT DISTINCT t FROM i) USING (t) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
p AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // total)))) AS v FROM tf JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(m * v) AS BIGINT) AS score FROM p JOIN i USING (t) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
