"""Leave-one-region-out surprisal of words after the word before, by counts that are sums over all regions of a language.

Texts are cut into words and paired where they are, in numpy, a slice of about ``sequences.SLICE_BYTES`` at a time. A slice sends
each distinct word and pair once, as a hash of 64 bits packed with those that go to the same bucket, and buckets send the sums
back in the same order: what returns holds no keys, and no pair is a row of its own. Only the sums are written.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import sequences as S
from textloom.sources.shared import kept

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
_START, _BEFORE, _PAIR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
#: Bits are whole numbers of this part of one, so that sums do not depend on their order.
_GRAIN = 1e9
#: Characters of text whose words and pairs go to one task, about.
TASK_CHARS = 1 << 22


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest kind that holds them all, after its width."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table, np.ndarray]]:
    """The part and the number within it of each slice, its rows, and the first row of each of its regions: whole regions of one part and
    language, which come sorted. A row without a region is by itself, and a region longer than a slice is alone. Slices do not
    depend on where batches end, so they are the same whenever they are made."""
    held: pa.Table | None = None
    latest, number = None, 0
    for batch in itertools.chain(batches, [None]):
        tables = [t for t in (held, batch and pa.Table.from_batches([batch])) if t]
        if not tables:
            continue
        rows = pa.concat_tables(tables)
        parts = rows.column("part").to_numpy()
        lang, region = (S._codes(pa.concat_arrays(rows.column(c).chunks)) for c in ("lang", "region"))
        other = np.append(True, (np.diff(lang) != 0) | (np.diff(parts) != 0))
        first = np.flatnonzero(other | np.append(True, np.diff(region) != 0) | (region < 0))
        ends = np.append(first, len(rows))
        size = np.append(0, np.cumsum(pa.compute.binary_length(rows.column("text")).to_numpy(), dtype=np.int64))[ends]
        bounds = np.searchsorted(ends, np.append(np.flatnonzero(other), len(rows)))
        low = 0
        while low < len(first):
            full = int(np.searchsorted(size, size[low] + S.SLICE_BYTES, "right")) - 1
            high = min(max(low + 1, full), int(bounds[np.searchsorted(bounds, low, "right")]))
            if batch is not None and high >= len(first) - 1:
                break  # its last region, or the slice, may go on in the next batch
            part = int(parts[ends[low]])
            latest, number = part, number + 1 if part == latest else 0
            yield part, number, rows.slice(ends[low], ends[high] - ends[low]), first[low:high] - first[low]
            low = high
        held = rows.slice(ends[low]) if low < len(first) else None


class _Slice:
    """Words and pairs of a slice of texts. ``keys`` are the hashes of its distinct words, with a start that is none, and then of its pairs."""

    def __init__(self, rows: pa.Table, first: np.ndarray) -> None:
        texts = pa.concat_arrays(rows.column("text").chunks).cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        hashes, row = S.word_hashes(data, offsets - offsets[0], _WORD)
        self.tokens = len(hashes)
        if not self.tokens:
            return
        salt = pd.util.hash_array(np.array([rows.column("lang")[0].as_py()], object))[0]
        names, word = np.unique(S.scrambled(hashes ^ salt), return_inverse=True)
        names = np.append(names, S.scrambled(salt + np.full(1, _START)))
        self.words = len(names)
        self.before = np.append(self.words - 1, word[:-1])
        self.before[np.append(True, row[1:] != row[:-1])] = self.words - 1
        pairs, self.pair = np.unique(self.before * self.words + word, return_inverse=True)
        self.head = pairs // self.words
        self.keys = np.concatenate((names, S.scrambled(names[self.head] * _BEFORE + names[pairs % self.words] * _PAIR)))
        having, self.region = np.unique(np.searchsorted(first, row, "right") - 1, return_inverse=True)
        self.having = first[having]

    def order(self, tasks: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys by their buckets, and the bucket of each; words stay before pairs."""
        bucket = (self.keys % np.uint64(tasks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def sent(self, tasks: int) -> list[tuple]:
        """For each bucket: its number, how many words go there, words of the texts (with the first bucket alone), keys and counts."""
        count = np.concatenate((np.bincount(self.before, minlength=self.words), np.bincount(self.pair)))
        order, bucket = self.order(tasks)
        out = [(int(bucket[at[0]]), int((order[at] < self.words).sum()), None, self.keys[order[at]].tobytes(), _packed(count[order[at]])) for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1)]
        out[0] = (*out[0][:2], self.tokens, *out[0][3:])
        return out

    def measured(self, sums: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
        """tokens, mean, p90 and most of each region that has words, by the sums of the keys."""
        own, times = np.unique(self.region * len(self.keys) + self.pair, return_counts=True)
        region, pair = own // len(self.keys), own % len(self.keys)
        head, first = self.head[pair], np.flatnonzero(np.append(True, np.diff(region) != 0))
        _, group = np.unique(region * self.words + head, return_inverse=True)
        local = np.bincount(group, times).astype(np.int64)[group]
        p = (sums[self.words + pair] - times + 1) / (sums[head] - local + vocabulary + 1)
        bits = np.floor(-np.log2(p) * _GRAIN + 0.5).astype(np.int64)
        tokens = np.add.reduceat(times, first)
        order = np.lexsort((bits, region))
        until = np.cumsum(times[order])
        at = (tokens - 1) * 0.9
        value = lambda k: bits[order[np.searchsorted(until, np.cumsum(tokens) - tokens + k.astype(np.int64), "right")]] / _GRAIN
        low, high = value(np.floor(at)), value(np.ceil(at))
        p90 = np.where(low == high, low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
        return tokens, np.add.reduceat(bits * times, first) / (tokens * _GRAIN), p90, np.maximum.reduceat(bits, first) / _GRAIN


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums for each slice that sent keys to this bucket and, without a part, how many words of a language are here and were told here."""
    tables = [pa.Table.from_batches([b]) for b in batches if len(b)]
    if not tables:
        return
    rows = pa.concat_tables(tables)
    part, number, bucket, langs, told = (pa.concat_arrays(rows.column(c).chunks) for c in ("part", "number", "bucket", "lang", "tokens"))
    words = rows.column("words").to_numpy()
    found = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("h")]
    size = np.array([len(h) for h in found])
    counts = np.concatenate([_unpacked(x.as_py()) for x in rows.column("n")])
    hashes = np.concatenate(found)
    del found, rows, tables
    _, key = np.unique(hashes, return_inverse=True)
    sums = np.zeros(key.max() + 1, np.int64)
    np.add.at(sums, key, counts)
    base = np.cumsum(size) - size
    at = np.repeat(base, words) + np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    _, once = np.unique(hashes[at], return_index=True)
    lang = S._codes(langs)
    _, each = np.unique(lang, return_index=True)
    known = np.bincount(np.repeat(lang, words)[once], minlength=len(each))
    tokens = np.zeros(len(each), np.int64)
    np.add.at(tokens, lang, told.fill_null(0).to_numpy(zero_copy_only=False))
    names, none = ["part", "number", "bucket", "lang", "tokens", "words", "sums"], pa.nulls(len(each), pa.int64())
    yield pa.record_batch([none, none, none, langs.take(pa.array(each)), pa.array(tokens), pa.array(known), pa.nulls(len(each), pa.binary())], names)
    back = pa.array([_packed(sums[key[b : b + n]]) for b, n in zip(base, size, strict=True)], pa.binary())
    yield pa.record_batch([part, number, bucket, langs, told, pa.nulls(len(back), pa.int64()), back], names)


def surprisal(docs: DataFrame, region: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, region, mean, p90 and most of -log2 of (c(pair) - local + 1) / (c(word before) - local + |V| + 1) over a region's words
    `[A-Za-z0-9_]+`, the first of a text after a start. Counts are a language's, local ones the region's; |V| is not left out. Rows of one region
    are counted as one. A row without a region counts for the others, and one without a language does not count; neither is
    measured, nor are regions without words or alone in their language.

    Texts are dealt over parts by language and region, and read twice: for the counts, and for the bits once the sums are back."""
    docs = docs.select(F.col(lang).alias("lang"), F.col(region).alias("region"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    kinds = dict(docs.dtypes)
    dealt = F.when(F.col("region").isNotNull(), F.xxhash64("lang", "region")).otherwise(F.xxhash64("lang", "text"))
    docs = docs.withColumn("part", F.pmod(dealt, F.lit(tasks)).cast("long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, rows, first in _slices(batches):
            found = _Slice(rows, first)
            if found.tokens:
                columns = list(zip(*found.sent(tasks), strict=True))
                n, longs = len(columns[0]), ["part", "number", "bucket", "words", "tokens"]
                own = [pa.array(c, pa.int64()) for c in ([part] * n, [number] * n, *columns[:3])]
                langs = pa.array([rows.column("lang")[0].as_py()] * n, rows.schema.field("lang").type)
                yield pa.record_batch([*own, langs, *[pa.array(c, pa.binary()) for c in columns[3:]]], [*longs, "lang", "h", "n"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[bytes]] = {}
        totals: dict[tuple[int, int], tuple[int, int]] = {}

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = batch.filter(batch.column("number").is_valid()).select(["part", "number", "bucket", "tokens", "words", "sums"])
                for part, number, bucket, tokens, words, back in zip(*(c.to_pylist() for c in told.columns), strict=True):
                    if bucket < 0:
                        totals[part, number] = tokens, words
                    else:
                        sums.setdefault((part, number), []).append(back)
                yield batch.filter(batch.column("number").is_null()).select(["part", "lang", "region", "text"])

        for part, number, rows, first in _slices(texts()):
            found = _Slice(rows, first)
            if found.tokens:
                (every, words), order = totals.pop((part, number)), found.order(tasks)[0]
                counts = np.empty(len(order), np.int64)
                counts[order] = np.concatenate([_unpacked(x) for x in sums.pop((part, number))])
                tokens, *columns = found.measured(counts, words)
                regions = pa.concat_arrays(rows.column("region").chunks).take(pa.array(found.having))
                at = pa.array(np.flatnonzero((tokens < every) & regions.is_valid().to_numpy(zero_copy_only=False)))
                langs = pa.concat_arrays(rows.column("lang").chunks).take(pa.array(found.having)).take(at)
                yield pa.record_batch([langs, regions.take(at), *[pa.array(c).take(at) for c in columns]], ["lang", "region", "mean", "p90", "most"])

    own = docs.repartition(tasks, "part").sortWithinPartitions("part", "lang", "region", "text")
    sent = own.mapInArrow(cut, f"part long, number long, bucket long, words long, tokens long, lang {kinds['lang']}, h binary, n binary")
    back = kept(sent.repartition(tasks, "bucket").mapInArrow(_met, f"part long, number long, bucket long, lang {kinds['lang']}, tokens long, words long, sums binary"))
    of_lang = back.where("part IS NULL").groupBy("lang").agg(F.sum("tokens").alias("tokens"), (F.sum("words") - 1).alias("words"))  # a start is no word
    slices = back.where("part IS NOT NULL AND tokens IS NOT NULL").select("part", "number", F.lit(-1).cast("long").alias("bucket"), "lang")
    told = slices.join(of_lang, "lang").drop("lang").unionByName(back.where("part IS NOT NULL").select("part", "number", "bucket", "sums"), allowMissingColumns=True)
    rows = told.unionByName(docs, allowMissingColumns=True).repartition(tasks, "part")
    rows = rows.sortWithinPartitions("part", F.col("number").isNull(), "bucket", "lang", "region", "text")
    out = rows.mapInArrow(measured, f"lang {kinds['lang']}, region {kinds['region']}, mean double, p90 double, most double")
    return out.select("lang", "region", *[F.round(c, 6).alias(c) for c in ("mean", "p90", "most")])
