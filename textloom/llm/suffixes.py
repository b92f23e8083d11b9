"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else.

*Dealing out.* Every window of ``LENGTH`` bytes has an anchor, the leftmost of the least hashes of its ``GRAM``-byte
substrings. Equal windows have equal anchors at equal offsets, so the windows of one anchor hash, kept as snippets
(runs of windows of one anchor), can be judged on their own, and hashes that occur once drop out by counting alone.
Equal snippets are counted, not shipped: two make all their windows repeats. The bytes of distinct snippets in the
remaining buckets go where their hash goes.

*Suffix array.* A bucket's snippets are cut into tokens of ``GRAIN`` bytes from the anchor, parted by separators, and
sorted by linear grouping construction: ``suffix_array`` takes groups of suffixes with a common Lyndon prefix in
descending order, finds for each suffix its previous smaller one by pointer jumping, and splits the groups of those by
how often they are pointed to; then each group's order is emitted by following the pointers from suffixes already
placed, without naming or recursion. Neighbours' common prefixes tell which windows at token boundaries repeat; an
exact comparison by hash settles the few windows that begin or end inside a token next to them.

*Hot buckets* of more than ``MOST_SNIPPETS`` distinct snippets would be one large group; each of their windows is
counted by its own hash instead, with partial aggregation, which is exact too.

Texts are known by their MD5, so repeated rows, repeated or null ids and clashing names make no difference: a text that
is there twice is covered by the other copy. A null text is empty, texts under ``LENGTH`` bytes lose nothing, an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels
from textloom.llm.storage import dropped, saved
from textloom.llm.texts import map_texts, named

LENGTH = 400
GRAM = 48
GRAIN = 16
MOST_SNIPPETS = 4000
#: Bytes of snippets that one suffix array holds, unless a single bucket has more.
CHUNK = 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order. The last symbol must be the only one of the least value."""
    n = len(text)
    symbols = sorted(set(text))
    group_of = {c: g for g, c in enumerate(symbols)}
    group = [group_of[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]  # neighbours in the groups' order
    left = [len(m) for m in members]  # members that no split has taken away
    smaller, done, falling = [-1] * n, bytearray(n), []
    current = len(symbols) - 1
    while current >= 0:
        own = members[current]
        if len(own) != left[current]:
            own = [i for i in own if group[i] == current]
        falling.append((current, len(own)))
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        most = 0
        for i in own:  # ascending, so pointers within the group are there already
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = times = pointed.get(j, 0) + 1
                if times > most:
                    most = times
        parts: list[dict[int, list[int]]] = [{} for _ in range(most + 1)]
        for j, times in pointed.items():  # ascending too
            parts[times].setdefault(group[j], []).append(j)
        for times in range(most, 0, -1):
            for g, part in parts[times].items():
                if len(part) == left[g]:
                    continue  # all that is left of the group moves on together
                new, over = len(members), above[g]  # right after what is left of the old group
                members.append(part)
                left.append(len(part))
                left[g] -= len(part)
                below.append(g)
                above.append(over)
                above[g] = new
                if over >= 0:
                    below[over] = new
                for j in part:
                    group[j] = new
        current = below[current]

    start, at = [0] * len(members), 0
    for g, size in reversed(falling):
        start[g] = at
        at += size
    out, placed = [-1] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix, in order, with the one before it."""
    n = len(text)
    rank, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if not r:
            k = 0
            continue
        j = order[r - 1]
        while text[i + k] == text[j + k]:  # the last symbol is unique
            k += 1
        out[r] = k
        if k:
            k -= 1
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows within rows with one anchor: first window, number of windows, anchor's place and hash."""
    n, width = len(data), LENGTH - GRAM + 1
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(kernels.byte_values()[data] * kernels.powers(kernels._BASE, n)[:n], out=sums[1:])
    h = kernels.mixed((sums[GRAM:] - sums[:-GRAM]) * kernels.powers(kernels._INVERSE, n)[: n - GRAM + 1])
    m = len(h)
    block = np.concatenate((h, np.full(-m % width, ~np.uint64(0)))).reshape(-1, width)
    place = np.arange(width, dtype=np.int32)
    base = (np.arange(len(block)) * width)[:, None]
    low = np.minimum.accumulate(block, 1)
    new = np.ones(block.shape, bool)
    new[:, 1:] = block[:, 1:] < low[:, :-1]
    low_at = (np.maximum.accumulate(np.where(new, place, 0), 1) + base).ravel()[width - 1 : m]
    low = low.ravel()[width - 1 : m]
    back = np.minimum.accumulate(block[:, ::-1], 1)
    same = block[:, ::-1] == back  # the last of these from the right is the leftmost
    back_at = (width - 1 - np.maximum.accumulate(np.where(same, place, 0), 1) + base)[:, ::-1].ravel()[: m - width + 1]
    back = back[:, ::-1].ravel()[: m - width + 1]
    anchor = np.where(back <= low, back_at, low_at)
    inside = np.zeros(len(anchor) + 1, np.int8)
    fits = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, np.minimum(offsets[1:][fits] - LENGTH + 1, len(anchor)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    change[offsets[:-1][fits]] = True
    starts = np.flatnonzero(change)
    count = np.diff(np.append(starts, len(anchor)))
    keep = inside[starts]
    starts, count = starts[keep], count[keep]
    return starts, count, anchor[starts], h[anchor[starts]]


def _key(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _light(data: np.ndarray, offsets: np.ndarray) -> list:
    starts, count, place, h = anchors(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    digest = kernels.span_hashes(data, starts, starts + count + LENGTH - 1) + (place - starts).astype(np.uint64)
    values = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), pa.array((starts - offsets[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((place - starts).astype(np.int32))], ["hash", "digest", "first", "count", "anchor"])
    return [pa.array(_key(data, offsets), pa.binary()), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)), values)]


_RUN = "struct<hash: long, digest: long, first: int, count: int, anchor: int>"


def _snippets(data: np.ndarray, offsets: np.ndarray, wanted: pa.Array) -> list:
    out = [[data[o + w["first"] : o + w["first"] + w["count"] + LENGTH - 1].tobytes() for w in own] for o, own in zip(offsets[:-1].tolist(), wanted.to_pylist(), strict=True)]
    return [pa.array(out, pa.list_(pa.binary()))]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, count: np.ndarray, anchor: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Mask over the windows of all snippets (count[k] for snippet k, in order) that equal another of their bucket."""
    shift = anchor % GRAIN
    n = (np.diff(offsets) - shift) // GRAIN  # tokens of each snippet
    snippet = np.repeat(np.arange(len(n)), n)
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[snippet] + shift[snippet] + index * GRAIN
    salted = kernels.mixed(kernels.span_hashes(data, at, at + GRAIN) + kernels.mixed(bucket.astype(np.uint64))[snippet])
    _, symbols = np.unique(salted, return_inverse=True)
    # separators are smallest and all different, the last the least of all
    place = np.arange(len(snippet)) + snippet
    text = np.empty(len(snippet) + len(n), np.int64)
    text[place] = symbols + len(n)
    text[np.cumsum(n + 1) - 1] = np.arange(len(n) - 1, -1, -1)
    symbols = text.tolist()
    order = suffix_array(symbols)
    shared = np.array(common_prefixes(symbols, order))
    order = np.array(order)
    starts_window = np.full(len(text), -1)  # the window that begins at each token
    window = shift[snippet] + index * GRAIN
    base = np.cumsum(count) - count
    starts_window[place] = np.where(window < count[snippet], base[snippet] + window, -1)
    own = np.flatnonzero(starts_window[order] >= 0)
    longest = np.full(count.sum(), -1)
    if len(own):
        between = np.zeros(len(own) + 1, np.int64)  # common prefix with the last such suffix before
        if len(own) > 1:
            between[1:-1] = _least_between(shared, own)
        longest[starts_window[order[own]]] = np.maximum(between[:-1], between[1:])
    tokens = LENGTH // GRAIN
    found = np.zeros(count.sum() + 1, np.int32)
    whole = np.flatnonzero(longest >= tokens)
    of = np.repeat(np.arange(len(count)), count)
    np.add.at(found, whole, 1)
    np.add.at(found, np.minimum(whole + GRAIN * (longest[whole] - tokens), (base + count - 1)[of[whole]]) + 1, -1)
    found = np.cumsum(found[:-1]) > 0
    # windows within a token: the next token's suffix must nearly reach, or begin no window here
    local = np.arange(len(of)) - base[of]
    further = local + (shift[of] - local) % GRAIN
    unsure = ~found & ((further >= count[of]) | (longest[np.minimum(base[of] + further, len(of) - 1)] >= tokens - 1)) & ((shift[of] - local) % GRAIN != 0)
    if unsure.any():
        relative = local - anchor[of]
        key = kernels.mixed(bucket.astype(np.uint64))[of] + kernels.mixed(relative.astype(np.int64).view(np.uint64))
        test = np.flatnonzero(np.isin(key, np.unique(key[unsure])))
        a = offsets[of[test]] + local[test]
        _, inverse, times = np.unique(kernels.mixed(kernels.span_hashes(data, a, a + LENGTH) + key[test]), return_inverse=True, return_counts=True)
        found[test] |= times[inverse] > 1
    return found


def _least_between(shared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Least of shared[own[k] + 1 .. own[k + 1]] for each k."""
    return np.minimum.reduceat(shared[: own[-1] + 1], own[:-1] + 1)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash -> byte ranges (key, start, end) of repeated windows."""
    held: list[pa.Table] = []

    def judged(table: pa.Table) -> pa.RecordBatch:
        data, offsets = kernels.buffers(table["snippet"])
        count, anchor, bucket, first = (table[c].to_numpy().astype(np.int64) for c in ("count", "anchor", "hash", "first"))
        found = repeated_windows(data, offsets, count, anchor, bucket)
        of = np.repeat(np.arange(len(count)), count)
        local = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        edge = np.ones(len(of) + 1, bool)
        edge[1:-1] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        cuts = np.flatnonzero(edge)
        low, high = cuts[:-1][found[cuts[:-1]]], cuts[1:][found[cuts[:-1]]]
        start, end = first[of[low]] + local[low], first[of[low]] + local[high - 1] + LENGTH
        return pa.record_batch([table["key"].combine_chunks().take(pa.array(of[low])), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["key", "start", "end"])

    def split(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        h = table["hash"].to_numpy()
        bounds = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h) if last else [])
        size = np.cumsum(pc.binary_length(table["snippet"]).to_numpy())
        low = 0
        while low < len(h) and len(bounds):
            enough = int(np.searchsorted(size, (size[low - 1] if low else 0) + CHUNK))
            later = bounds[bounds > low]
            if not len(later):
                break
            high = int(later[np.searchsorted(later, enough, "right") - 1]) if (later <= enough).any() else int(later[0])
            if not last and high == later[-1] and enough >= len(h):
                break  # more of this chunk may follow
            yield judged(table.slice(low, high - low))
            low = high
        held[:] = [table.slice(low)] if low < len(h) else []

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.nbytes for t in held) >= 2 * CHUNK:
            yield from split(pa.concat_tables(held).combine_chunks(), False)
    if held:
        yield from split(pa.concat_tables(held).combine_chunks(), True)


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a hot bucket's snippets with its own hash."""
    for batch in batches:
        for low in range(0, len(batch), 1000):
            part = batch.slice(low, 1000)
            data, offsets = kernels.buffers(part.column("snippet"))
            count, anchor, first = (part.column(c).to_numpy().astype(np.int64) for c in ("count", "anchor", "first"))
            of = np.repeat(np.arange(len(count)), count)
            local = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[of] + local
            own = kernels.span_hashes(data, at, at + LENGTH) + kernels.mixed((local - anchor[of]).view(np.uint64))
            yield pa.record_batch([part.column("key").take(pa.array(of)), pa.array(own.view(np.int64)), pa.array((first[of] + local).astype(np.int32))], ["key", "window", "start"])


def _apply(data: np.ndarray, offsets: np.ndarray, ranges: pa.Array) -> list:
    removed, spans, digests, texts = [], [], [], []
    for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ranges.to_pylist(), strict=True):
        text = data[a:b]
        if own:
            change = np.zeros(b - a + 1, np.int32)
            np.add.at(change, [x["start"] for x in own], 1)
            np.add.at(change, [x["end"] for x in own], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            text = text[~gone]
        else:
            removed.append(0)
            spans.append(0)
        texts.append(text.tobytes())
        digests.append(hashlib.sha256(text).hexdigest())
    return [np.diff(offsets), removed, spans, digests, pa.array(texts, pa.binary())]


def repeats(docs: DataFrame, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """key (MD5 of the text) and ranges, an array of byte ranges that are covered by repeated strings."""
    keyed = map_texts(docs.select("text"), _light, f"key binary, runs array<{_RUN}>", [])
    runs = saved(keyed.select("key", F.explode("runs").alias("run")).select("key", "run.*"), "runs")
    per = runs.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "count", "anchor")).alias("one"))
    per = saved(per, "digests")
    size = per.groupBy("hash").agg(F.count("*").alias("distinct"), F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1")
    copies = runs.join(per.where("n > 1").select("hash", "digest"), ["hash", "digest"]).select("key", F.col("first").alias("start"), (F.col("first") + F.col("count") + (LENGTH - 1)).alias("end")).distinct()
    open_ = size.where("distinct > 1 AND least = 1").select("hash", "distinct")
    wanted = per.join(open_, "hash").select("one.*", "hash", "distinct")
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("hash", "distinct", "first", "count", "anchor")).alias("wanted"))
    texts = docs.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")).join(asked, "key").dropDuplicates(["key"])
    cut = map_texts(texts, _snippets, "snippets array<binary>", ["key", "wanted"], also=[F.col("wanted")])
    cut = cut.select("row.key", F.explode(F.arrays_zip("row.wanted", "snippets")).alias("x")).select("key", "x.wanted.*", F.col("x.snippets").alias("snippet"))
    cut = saved(cut, "snippets")
    dealt = cut.where(F.col("distinct") <= most_snippets).select("key", "hash", "first", "count", "anchor", "snippet").repartition("hash").sortWithinPartitions("hash")
    used = [runs, per, cut]
    ranges = copies.unionByName(dealt.mapInArrow(_buckets, "key binary, start int, end int"))
    hot = cut.where(F.col("distinct") > most_snippets)
    if not hot.isEmpty():
        windows = saved(hot.select("key", "first", "count", "anchor", "snippet").mapInArrow(_hot_windows, "key binary, window long, start int"), "windows")
        used.append(windows)
        twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        ranges = ranges.unionByName(windows.join(twice, "window").select("key", "start", (F.col("start") + LENGTH).alias("end")))
    found = saved(ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    dropped(*used)
    return found


def dedup(docs: DataFrame, carry: list[str] | None = None, most_snippets: int = MOST_SNIPPETS) -> DataFrame:
    """``row`` (the columns of ``carry``) with n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay."""
    carry = docs.columns if carry is None else carry
    found = repeats(docs, most_snippets)
    rows = docs.select(F.struct(*[named(c) for c in carry]).alias("row"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"))
    joined = rows.join(found, "key", "left")
    out = map_texts(joined, _apply, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", ["row"], also=[F.col("ranges")])
    return out.select("row.row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
