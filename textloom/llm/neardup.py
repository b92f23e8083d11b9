"""MinHash near-dedup with SetSketch registers.

A document's set is that of its distinct five-word shingles. Each of ``REGISTERS`` registers takes the minimum of an
exponentially distributed hash over the set and keeps it as a truncated exponent of base ``BASE``: minima of exponents
merge by maximum, and two sets agree in a register about as often as their Jaccard similarity. Registers are banded,
and documents that share all registers of a band are candidates. The likelihood of the numbers of registers that are
greater, less and equal, given both set sizes, estimates the similarity of a candidate; only those whose best estimate
is clearly below the threshold go, and every other pair is confirmed on the full sets.

Bands follow from the threshold: 20 of 5 registers at 0.85, where a pair of that similarity shares no band with a
probability of 8e-6 at most, and 25 of 4 at 0.8 with 2e-6. The estimate of a pair at the threshold falls below the cut,
``ERRORS`` standard errors away, with about 2e-5 and 9e-6; all fall fast for pairs more alike.

Skew. Documents of equal sets are one class, joined to its smallest id, so copies are never paired. In each bucket of a
band all members are first paired with the smallest one: n - 1 pairs for n members. Confirmed pairs give components;
buckets that lie in one component need nothing more, whatever their size. In others, members of different components
are compared by their registers, in blocks of about ``BLOCK`` by ``BLOCK`` members; members that have a likely partner
get their texts, and likely pairs are confirmed in the block, so only members and links leave it, however many are nearly
alike. Every candidate pair of a bucket is thus confirmed, discarded by its estimate, or within a component already.

A bucket of so many members without links that blocks would copy each more than ``MOST_COPIES`` times, such as one
template filled in by many, is split first by what its members have that others have not: shingles are put in the
order of how many members have them (counted in ``SLOTS`` counters, which any total order may be made from), and a pair at
the threshold must share one of the first ``n - ceil(threshold * n) + 1`` of both. Members that share such a rare shingle are
compared as those of a bucket are. Nothing is lost by it, and what the template says is never looked at.

Cases: a null, empty or blank text has an empty set, is linked with nothing and kept; fewer than five words are one
shingle; rows of equal ids are one document as far as links go, and each keeps its row; a null id gets the smallest id
of its component, or null, and is kept only then; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels
from textloom.llm.storage import dropped, saved
from textloom.llm.texts import map_texts, named

WORDS = 5
#: Linked when threshold[1] * intersection >= threshold[0] * union; this one unless another is asked for.
THRESHOLD = (85, 100)
REGISTERS = 100
#: Pairs at the threshold may share no band with this probability at most.
MISSED = 1e-5
BASE = 1.1
#: What is added to exponents so that one byte holds those of sets of 1 to 10 ** 8 shingles.
SHIFT = 40
#: Pairs whose likeliest similarity is so many standard errors below the threshold are not confirmed.
ERRORS = 4.75
BLOCK = 256
#: Block pairs that the members of a bucket are copied to, on average, before it is split by rare shingles.
MOST_COPIES = 16
#: Counters of shingles (8 bytes each), broadcast.
SLOTS = 1 << 20
#: Up to so many candidates' ids (8 bytes each) are broadcast to pick out their texts; beyond, texts are shuffled.
MOST_BROADCAST = 1_000_000
_GRID = np.linspace(0.0, 1.0, 101)


def bands_and_rows(threshold: tuple[int, int]) -> tuple[int, int]:
    """Bands and registers in each: the longest bands that find pairs at the threshold as surely as ``MISSED`` says."""
    t = threshold[0] / threshold[1]
    rows = next((r for r in (10, 5, 4, 2) if (1 - t**r) ** (REGISTERS // r) <= MISSED), 1)
    return REGISTERS // rows, rows


def least_likely(threshold: tuple[int, int]) -> float:
    t = threshold[0] / threshold[1]
    return t - ERRORS * (t * (1 - t) / REGISTERS) ** 0.5


def linked(both: int, n_a: int, n_b: int, threshold: tuple[int, int]) -> bool:
    return threshold[1] * both >= threshold[0] * (n_a + n_b - both)


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted within it, and each row's first."""
    data = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
    hashes = kernels.span_hashes(data, starts, ends)
    n = np.diff(first)
    grams = kernels.gram_hashes(hashes, WORDS)
    row = kernels.row_of(first)
    inside = row[: len(grams)] == row[WORDS - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    whole = np.array([kernels.gram_hashes(hashes[first[k] : first[k + 1]], int(n[k]))[0] + np.uint64(n[k]) for k in short], np.uint64)
    rows, found = np.concatenate((row[: len(grams)][inside], short)), np.concatenate((grams[inside], whole))
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    rows, found = rows[new], found[new]
    return found, np.searchsorted(rows, np.arange(len(offsets)))


def registers(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A matrix of registers (bytes) with a row for each non-empty set."""
    full = first[:-1][np.diff(first) > 0]
    out = np.empty((len(full), REGISTERS), np.uint8)
    for k, a in enumerate(_multipliers()):
        least = np.minimum.reduceat(found * a, full) if len(full) else np.zeros(0, np.uint64)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        out[:, k] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + SHIFT, 0, 255)
    return out


def _sketch(data: np.ndarray, offsets: np.ndarray) -> list:
    found, first = shingles(data, offsets)
    n = np.diff(first)
    full = n > 0
    sets, sketch = [None] * len(n), [None] * len(n)
    if full.any():
        at = first[:-1][full]
        a, b = (np.add.reduceat(kernels.mixed(found + np.uint64(s)), at) for s in (1, 2))
        regs = registers(found, first)
        for k, i in enumerate(np.flatnonzero(full).tolist()):
            sets[i] = a[k].tobytes() + b[k].tobytes()
            sketch[i] = regs[k].tobytes()
    return [n, pa.array(sets, pa.binary()), pa.array(sketch, pa.binary())]


def _banded(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """id, band, bucket: a bucket is the hash of a band's number and registers."""
    bands, rows = bands_and_rows(threshold)
    for batch in batches:
        regs = _matrix(batch.column("regs"))
        keys = np.zeros((len(regs), bands), np.uint64)
        for j in range(rows):
            keys = keys * np.uint64(0xD6E8FEB86659FD93) + regs[:, j * bands : (j + 1) * bands]
        keys = kernels.mixed(kernels.mixed(keys) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(regs)), bands)))
        yield pa.record_batch([ids, pa.array(np.tile(np.arange(bands, dtype=np.int32), len(regs))), pa.array(keys.ravel())], ["id", "band", "bucket"])


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair, jointly from registers that are greater, less and equal."""
    out = np.empty(len(a))
    for low in range(0, len(a), 4096):
        high = low + 4096
        x, y = a[low:high], b[low:high]
        more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
        u = (n_a[low:high] / (n_a[low:high] + n_b[low:high]))[:, None]
        v = 1 - u
        j = _GRID[None] * np.minimum(u / v, v / u)
        p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        p_more, p_less = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        same = np.clip(1 - p_more - p_less, 1e-12, 1)
        likely = more * np.log(p_more) + less * np.log(p_less) + (REGISTERS - more - less) * np.log(same)
        out[low:high] = j[np.arange(len(x)), likely.argmax(1)]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = kernels.buffers(column)
    return data.reshape(len(offsets) - 1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    least = least_likely(threshold)
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        keep = estimated(_matrix(batch.column("regs_a")), _matrix(batch.column("regs_b")), n_a, n_b) >= least
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirm(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for low in range(0, len(batch), 64):
            part = batch.slice(low, 64)
            (x, x_first), (y, y_first) = (shingles(*kernels.buffers(part.column(c))) for c in ("text_a", "text_b"))
            for k in range(len(part)):
                a, b = x[x_first[k] : x_first[k + 1]], y[y_first[k] : y_first[k + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(linked(both, len(a), len(b), threshold))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bands_shared(regs: np.ndarray, other: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The first band in which each row of ``regs`` agrees with ``other`` in full; ``bands`` if none."""
    same = (regs == other).reshape(-1, rows, bands).all(1)
    return np.where(same.any(1), same.argmax(1), bands)


def _likely_in_block(table: pa.Table, threshold: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of the left block with the rows of the right one that are likely linked to it, of another component. A
    pair is looked at in the first band that it shares and nowhere else."""
    least = least_likely(threshold)
    ids, comp, n, side, band = (table[c].to_numpy() for c in ("id", "component", "n", "side", "band"))
    regs = _matrix(table["regs"])
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)  # 1: a block against itself
    for i in left.tolist():
        other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (side[right] != 1))]
        other = other[np.minimum(n[other], n[i]) * threshold[1] >= np.maximum(n[other], n[i]) * threshold[0]]
        if band[i] >= 0:  # else they share a rare shingle, whatever their bands
            other = other[_bands_shared(regs[other], regs[i], *bands_and_rows(threshold)) == band[i]]
        if len(other):
            likely = estimated(np.repeat(regs[i][None], len(other), 0), regs[other], np.full(len(other), float(n[i])), n[other].astype(float)) >= least
            if likely.any():
                yield i, other[likely]


def _partnered(table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """The rows of a block pair that have a likely partner."""
    table = table.combine_chunks()
    keep = np.zeros(len(table), bool)
    for i, other in _likely_in_block(table, threshold):
        keep[i] = True
        keep[other] = True
    return table.filter(pa.array(keep))


def _across(table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """Linked pairs of a block pair's likely ones, confirmed on their full sets."""
    ids = table["id"].to_numpy()
    data, offsets = kernels.buffers(table["text"])
    sets: dict[int, np.ndarray] = {}
    for low, high in kernels.slices(offsets):
        at = offsets[low : high + 1]
        found, first = shingles(data[at[0] : at[-1]], at - at[0])
        sets |= {low + k: found[first[k] : first[k + 1]] for k in range(high - low)}
    out = []
    for i, other in _likely_in_block(table, threshold):
        for j in other.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if linked(both, len(sets[i]), len(sets[j]), threshold):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id in ``links`` (a, b): labels fall along links and then along
    labels until none falls; each round is written out, so no lineage grows."""
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = saved(lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        changed = after.where("label <> old").limit(1).count()
        dropped(labels)
        labels = after.select("id", "label")
        if not changed:
            dropped(both)
            return labels.withColumnRenamed("label", "component")


def _star_links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) that are linked: likely by their registers, then confirmed on their texts."""
    regs = sets.select("id", "n", "regs")
    pairs = pairs.join(regs.toDF("a", "n_a", "regs_a"), "a").join(regs.toDF("b", "n_b", "regs_b"), "b")
    pairs = saved(pairs.mapInArrow(lambda batches: _likely(batches, threshold), "a long, b long"), "pairs")
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = saved(joined.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _confirm(batches, threshold), "a long, b long").distinct(), "links")
    dropped(pairs)
    return links


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> slot, n: how many of a task's texts have shingles of each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        data, offsets = kernels.buffers(batch.column("text"))
        for low, high in kernels.slices(offsets):
            at = offsets[low : high + 1]
            found, _ = shingles(data[at[0] : at[-1]], at - at[0])
            counts += np.bincount((found % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])


def rare_first(found: np.ndarray, counts: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Of a set's shingles, those of which two linked sets must share one: the first in the order of counts, then hashes."""
    keep = len(found) - -(-len(found) * threshold[0] // threshold[1]) + 1
    return found[np.lexsort((found, counts[(found % np.uint64(SLOTS)).astype(np.int64)]))[:keep]]


def _rare(batches: Iterator[pa.RecordBatch], counts, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """id, component, text -> bucket, band, id, component: a bucket for each rare shingle."""
    for batch in batches:
        data, offsets = kernels.buffers(batch.column("text"))
        for low, high in kernels.slices(offsets):
            at = offsets[low : high + 1]
            found, first = shingles(data[at[0] : at[-1]], at - at[0])
            own = [rare_first(found[first[k] : first[k + 1]], counts.value, threshold) for k in range(high - low)]
            row = pa.array(np.repeat(np.arange(low, high), [len(x) for x in own]))
            keys = np.concatenate(own) if own else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), -1, np.int32)), batch.column("id").take(row), batch.column("component").take(row)], ["bucket", "band", "id", "component"])


def _cross_links(members: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between members of different components of a bucket."""
    labelled = members.join(labels, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    sized = saved(_sized(labelled, 3), "buckets")  # the one pair of a bucket of two has been compared
    links = [_blocked(labelled, sized.where(F.col("copies") <= MOST_COPIES), sets, texts, threshold)]
    hot = sized.where(F.col("copies") > MOST_COPIES).select("bucket")
    if not hot.isEmpty():
        ids = labelled.join(hot, "bucket", "left_semi").select("id", "component").distinct()
        rows = saved(ids.join(texts, "id").select("id", "component", "text"), "hot")
        found = rows.select("text").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(SLOTS, np.int64)
        counts[found["slot"].to_numpy()] = found["n"].to_numpy()
        counts = rows.sparkSession.sparkContext.broadcast(counts)
        rare = saved(rows.mapInArrow(lambda batches: _rare(batches, counts, threshold), "bucket long, band int, id long, component long").distinct(), "rare")
        links.append(_blocked(rare, _sized(rare, 2), sets, texts, threshold))
        dropped(rows, rare)
        counts.destroy()
    out = saved(links[0].union(links[1]).distinct(), "links") if len(links) > 1 else links[0]
    dropped(sized, *(links if len(links) > 1 else []))
    return out


def _sized(labelled: DataFrame, least: int) -> DataFrame:
    """bucket, big (its largest component), m and r (blocks of that one and of the rest), copies (block pairs that a member
    goes to, on average) of the buckets of ``least`` members or more, and of more than one component."""
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    bucket = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("size"), F.count("*").alias("parts")).where((F.col("parts") > 1) & (F.col("size") >= least))
    m, r = F.ceil(F.col("big.n") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("big.n")) / BLOCK).cast("int")
    rest = F.col("size") - F.col("big.n")
    return bucket.select("bucket", F.col("big.component").alias("big"), m.alias("m"), r.alias("r"), ((F.col("big.n") * r + rest * (m + r)) / F.col("size")).alias("copies"))


def _blocked(labelled: DataFrame, bucket: DataFrame, sets: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between members (bucket, band, id, component) of the buckets given. A bucket's largest component is blocked apart from
    the rest, as no two of its members need comparing: a row of it goes to as many block pairs as the rest has blocks."""
    rows = labelled.join(bucket.select("bucket", "big", "m", "r"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    m, r = F.col("m"), F.col("r")
    of_big = F.transform(count(r), lambda k: cell(k, own(m) + r, F.lit(2)))
    of_rest = F.concat(
        F.transform(count(m), lambda k: cell(own(r), k + r, F.lit(0))),
        F.transform(count(r), lambda k: cell(F.least(own(r), k), F.greatest(own(r), k), F.when(own(r) == k, 1).when(own(r) < k, 0).otherwise(2))),
    )
    cells = rows.select("bucket", "band", "id", "component", F.explode(F.when(F.col("component") == F.col("big"), of_big).otherwise(of_rest)).alias("x")).select("bucket", "band", "id", "component", "x.*")
    columns = "bucket long, band int, id long, component long, i int, j int, side int, n long, regs binary"
    cells = cells.join(sets.select("id", "n", "regs"), "id").select(*[c.split()[0] for c in columns.split(", ")])
    likely = saved(cells.groupBy("bucket", "i", "j").applyInArrow(lambda table: _partnered(table, threshold), columns), "likely")
    links = saved(likely.join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(lambda table: _across(table, threshold), "a long, b long").distinct(), "links")
    dropped(likely)
    return links


def grouped(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = map_texts(rows, _sketch, "n long, set binary, regs binary", ["doc_id"])
    sketched = saved(sketched.select("row.doc_id", "n", "set", "regs"), "sketches")
    # one row for each distinct set, named by its smallest id
    sets = saved(sketched.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "sets")
    banded = sets.where("id IS NOT NULL").select("id", "regs").mapInArrow(lambda batches: _banded(batches, threshold), "id long, band int, bucket long")
    first = banded.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a")
    members = saved(banded.join(first, "bucket"), "members")
    ids = members.select("id").distinct()
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    texts = saved(rows.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    star = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = _star_links(star, sets, texts, threshold)
    labels = components(links)
    more = _cross_links(members, labels, sets, texts, threshold)
    if not more.isEmpty():
        before, labels = labels, components(links.union(more))
        dropped(before)
    dropped(members, texts, links, more)
    by_set = sets.join(labels, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    out = sketched.select("doc_id", "n", "set").join(by_set, "set", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def dedup(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents that stay: one of each component, the one with the smallest id; of rows that repeat it, all. Rows
    without an id stay, as nothing tells which of them a component's one would be."""
    gone = grouped(docs, threshold).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])
