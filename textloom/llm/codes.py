"""Compression of vectors to codes: product quantisation by filtering Lloyd rounds.

Vectors become integers and are cut into parts; every part position has a codebook, so all arithmetic is exact. In each
round a task builds a kd-tree for every part position over the parts of a block of its rows. A node has the bounding box,
sum and count of its parts. All nodes of a level are looked at together: a codebook entry is out of the race for a node
if another one is nearer in the whole box, or as near with a lower index, which the corner of the box farthest along
their difference settles. A node with one entry left is assigned as a whole, by its cached sum and count; others pass
what is left on to their children, and leaves compare their parts with what is left. Tasks give sums and counts, one
row an entry and part position, which are added up in one aggregation; codebooks (parts x entries rows) are all that
is broadcast or gathered, whatever the input. The last assignment goes through the same trees.

Cases: rows whose vector is null or has null, infinite or NaN components are dropped; the vectors' length is that of the
smallest kept vec_id's, and kept rows of another length have a null code and error; a length that the number of
parts does not divide is cut as evenly as can be, in order; a component beyond 65,536 counts as that, so that sums fit 64
bits; with fewer kept rows than entries, codebooks are as short as that; rows that share a vec_id are rows each (first
entries are taken by vec_id, nulls last, then by vector); null labels are one label; an empty table gives an empty table;
other columns never clash, as only those named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.storage import saved
from textloom.llm.texts import named

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts in a leaf of a tree, at most twice as many; numbers in one numpy intermediate; rows of one tree.
LEAF, MOST_NUMBERS, MOST_ROWS = 12, 1 << 21, 1 << 15
#: Labels whose sums are broadcast; more are joined over shuffles.
MOST_LABELS = 100_000
LARGEST = 65_536.0


@dataclass
class Codebooks:
    """entries[part] is an integer array (entries x positions) for each part; ``size`` is the vectors' length."""

    entries: list[np.ndarray]
    size: int

    def digest(self) -> str:
        numbers = ",".join(str(x) for part in self.entries for entry in part.tolist() for x in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def cuts(size: int, parts: int) -> list[int]:
    return [size * k // parts for k in range(parts + 1)]


class Tree:
    """A balanced kd-tree: node j of level l has children 2j and 2j + 1, and places bounds[l][j] to bounds[l][j + 1]."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.depth = max(0, (n // LEAF).bit_length() - 1)
        self.order, bounds = np.arange(n), np.array([0, n])
        self.bounds = [bounds]
        for _ in range(self.depth):
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            sorted_points = points[self.order]
            spread = np.maximum.reduceat(sorted_points, bounds[:-1]) - np.minimum.reduceat(sorted_points, bounds[:-1])
            widest = spread.argmax(1)
            self.order = self.order[np.lexsort((sorted_points[np.arange(n), widest[node]], node))]
            halves = np.empty(2 * len(bounds) - 1, np.int64)
            halves[::2], halves[1::2] = bounds, (bounds[:-1] + bounds[1:]) // 2
            bounds = halves
            self.bounds.append(bounds)
        self.points = points[self.order]
        low, high = (f.reduceat(self.points, bounds[:-1]) for f in (np.minimum, np.maximum))
        total, count = np.add.reduceat(self.points, bounds[:-1]), np.diff(bounds)
        self.levels = [(low, high, total, count)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            total, count = total[::2] + total[1::2], count[::2] + count[1::2]
            self.levels.append((low, high, total, count))
        self.levels.reverse()


def _left(low: np.ndarray, high: np.ndarray, among: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of the entries ``among`` (nodes x entries) can be nearest for some place of each node's box."""
    middle = ((2 * entries - (low + high)[:, None, :]) ** 2).sum(2)
    middle[~among] = np.iinfo(np.int64).max
    star = middle.argmin(1)
    best = entries[star]
    toward = best[:, None, :] - entries
    corner = np.where(toward > 0, low[:, None, :] * toward, high[:, None, :] * toward).sum(2)
    # the most by which the star is farther than an entry within the box; none is dropped for itself
    worse = (best**2).sum(1)[:, None] - (entries**2).sum(1) - 2 * corner
    return among & ~((worse < 0) | (worse == 0) & (star[:, None] < np.arange(len(entries))))


def assigned(points: np.ndarray, entries: np.ndarray, sums_only: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """The nearest entry of each point (None if only sums are asked for), and sums and counts by entry."""
    n, k, size = len(points), len(entries), points.shape[1]
    sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    code = None if sums_only else np.zeros(n, np.int64)
    if not n or not size:
        counts[0] = n
        return code, sums, counts
    tree = Tree(points)
    node, among = np.zeros(1, np.int64), np.ones((1, k), bool)
    step = max(1, MOST_NUMBERS // (k * size))
    for level, (low, high, total, count) in enumerate(tree.levels):
        for at in range(0, len(node), step):
            some = slice(at, at + step)
            among[some] = _left(low[node[some]], high[node[some]], among[some], entries)
        single = among.sum(1) == 1
        if single.any():
            done, entry = node[single], among[single].argmax(1)
            np.add.at(sums, entry, total[done])
            np.add.at(counts, entry, count[done])
            if code is not None:
                code[_places(tree.bounds[level], done)] = np.repeat(entry, count[done])
        node, among = node[~single], among[~single]
        if level < tree.depth:
            node, among = np.stack((2 * node, 2 * node + 1), 1).ravel(), np.repeat(among, 2, 0)
    for at in range(0, len(node), step):
        leaves = node[at : at + step]
        places = _places(tree.bounds[-1], leaves)
        of, entry = np.nonzero(np.repeat(among[at : at + step], tree.levels[-1][3][leaves], 0))
        far = ((tree.points[places[of]] - entries[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        least = np.minimum.reduceat(far, first)
        hit = np.flatnonzero(far == least[of])
        hit = hit[np.concatenate(([True], of[hit][1:] != of[hit][:-1]))]  # of equal ones the lowest index
        np.add.at(sums, entry[hit], tree.points[places])
        np.add.at(counts, entry[hit], 1)
        if code is not None:
            code[places] = entry[hit]
    if code is not None:
        own = np.empty(n, np.int64)
        own[tree.order] = code
        code = own
    return code, sums, counts


def _places(bounds: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """All places of some nodes, node after node."""
    sizes = bounds[nodes + 1] - bounds[nodes]
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[nodes] - (ends - sizes), sizes)


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is complete and finite, with ``vector`` of doubles."""
    x = named(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(named(vector).isNotNull() & F.coalesce(whole, F.lit(False)))


def _integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors of the given length, as integers, and which rows they are of."""
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == size)
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64).reshape(len(right), size), right


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of ``MOST_ROWS`` or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MOST_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks of the means, rounded down, of the parts that are nearest to each entry."""
    at = cuts(books.size, len(books.entries))
    spread = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        sums = [np.zeros_like(e) for e in own.entries]
        counts = [np.zeros(len(e), np.int64) for e in own.entries]
        for block in _blocks(batches):
            points, _ = _integers(block.column(0), own.size)
            for k, entries in enumerate(own.entries):
                _, s, c = assigned(points[:, at[k] : at[k + 1]], entries, True)
                sums[k] += s
                counts[k] += c
        rows = [(k, e, int(c), s.tolist()) for k in range(len(sums)) for e, (c, s) in enumerate(zip(counts[k], sums[k], strict=True)) if c]
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.record_batch(columns, names=["part", "entry", "n", "sums"])

    partial = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    widest = max(b - a for a, b in zip(at, at[1:], strict=False))
    totals = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(widest)]
    out = [e.copy() for e in books.entries]
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # a row an entry
        size = at[row.part + 1] - at[row.part]
        out[row.part][row.entry] = [row[f"s{j}"] // row.n for j in range(size)]
    return Codebooks(out, books.size)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after some rounds over all rows; None without any."""
    rows = kept(vectors, vector).select(named(vec_id).alias("vec_id"), named(vector).cast("array<double>").alias("vector"))
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "vector")
    smallest = least.limit(1).collect()
    if not smallest:
        return None
    size = len(smallest[0].vector)
    rows = rows.where(F.size("vector") == size)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    points, _ = _integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), size)
    at = cuts(size, parts)
    books = Codebooks([points[:, at[k] : at[k + 1]].copy() for k in range(parts)], size)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, carry: list[str], vector: str = "embedding") -> DataFrame:
    """``row`` (the columns of ``carry``) of the kept rows, with ``codes`` (an entry a part) and ``error``."""
    at = cuts(books.size, len(books.entries))
    spread = vectors.sparkSession.sparkContext.broadcast(books)
    rows = kept(vectors, vector).select(F.struct(*[named(c) for c in carry]).alias("row"), named(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for block in _blocks(batches):
            points, right = _integers(block.column("vector"), own.size)
            codes, error = np.zeros((len(right), len(own.entries)), np.int32), np.zeros(len(right), np.int64)
            for k, entries in enumerate(own.entries):
                part = points[:, at[k] : at[k + 1]]
                codes[:, k], _, _ = assigned(part, entries, False)
                error += ((part - entries[codes[:, k]]) ** 2).sum(1)
            place = np.full(block.num_rows, -1)
            place[right] = np.arange(len(right))
            there = pa.array(place, pa.int64(), mask=place < 0)
            lists = pa.ListArray.from_arrays(np.arange(len(right) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())
            yield pa.record_batch([block.column("row"), lists.take(there), pa.array(error).take(there)], names=["row", "codes", "error"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL("codes array<int>, error long")]))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the kept rows."""
    books = fit(vectors, parts=parts, entries=entries, rounds=rounds)
    schema = vectors.select(named("vec_id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if books is None:
        return schema.limit(0)
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = saved(encode(vectors, books, ["vec_id", "label"]).select(F.col("row")["vec_id"].alias("vec_id"), F.col("row")["label"].alias("label"), digits.alias("code"), "error"), "coded")
    labels = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    return _with_sums(coded, labels, MOST_LABELS).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _with_sums(coded: DataFrame, labels: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """Each row with its label's sum; labels are unique, and one may hold most rows, so many labels are salted."""
    other = labels.withColumnRenamed("label", "own")
    if labels.count() <= most:
        return coded.join(F.broadcast(other), coded["label"].eqNullSafe(other["own"])).drop("own")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    other = other.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(other, salted["label"].eqNullSafe(other["own"]) & (salted["salt"] == other["own_salt"])).drop("own", "salt", "own_salt")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The query of vectors of one length with unique ids in DuckDB's SQL."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT vec_id, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far"
            f" FROM p JOIN c{k} USING (part)) GROUP BY vec_id, part)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, entry, place, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS place FROM p JOIN a{k} USING (vec_id, part)) GROUP BY ALL),"
                f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT part, entry, list(v ORDER BY place) AS c FROM m{k} GROUP BY ALL) n USING (part, entry))"
            )
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, CAST(part AS BIGINT) AS part, v[len(v) * part // {parts} + 1:len(v) * (part + 1) // {parts}] AS x FROM e, (SELECT unnest(range({parts})) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY row_number() OVER (ORDER BY vec_id) <= {entries}),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN f USING (vec_id)),
{", ".join(steps)},
o AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
g AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM o JOIN e USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN e USING (vec_id) JOIN g ON g.label IS NOT DISTINCT FROM e.label, h
"""
