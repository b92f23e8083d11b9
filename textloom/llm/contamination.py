"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The words of each document are streamed through the automaton, which keeps the length of the longest suffix read so
far that occurs in any item. Where it reaches ``window`` words, the last that many are a window of an item; the state
tells of which items. An item of fewer words is one window of its own, found along suffix links. Places where not even
two words in a row occur together in an item send the automaton back to its root, so numpy finds the runs between
such places and only runs that can hold a whole window are streamed.

Memory: an automaton holds about ``most_words`` words. A longer item is cut into pieces that overlap by a window less a
word, so no window is lost; pieces are dealt over several automata by a hash. Each automaton is gathered, broadcast and
passed over the documents in a job of its own, written out before the next one is made, so what a task or the driver
holds never grows with the benchmark.

Cases: a null or wordless text has no words and no hits; null or wordless items have no windows; items with a null id
hit but are not listed; repeated rows and ids are judged row by row; an empty benchmark hits nothing, and an empty
table gives an empty table; documents' other columns never clash, as they stay inside a struct.
"""

from __future__ import annotations

from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels
from textloom.llm.storage import dropped, saved
from textloom.llm.texts import map_texts

WINDOW = 10
#: Words in one automaton: about 60 MB of Python objects.
MOST_WORDS = 100_000
#: Documents with a larger part of their words hit are dropped by ``decontaminate``; else hit spans are cut out.
MOST_COVERED = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, window: int) -> None:
        self.window, self.next, self.link, self.size = window, [{}], [-1], [0]
        self.items: dict[int, set] = defaultdict(set)  # by state that holds a window's string
        self.short: dict[int, list] = defaultdict(list)  # (length, item)

    def _state(self, size: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, source: int, word: int, target: int) -> int:
        """The state of exactly the strings up to ``source`` and then ``word``, parted from ``target``'s longer ones."""
        twin = self._state(self.size[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = twin
            source = self.link[source]
        return twin

    def add(self, sequence: list[int]) -> None:
        at = 0
        for word in sequence:
            known = self.next[at].get(word)
            if known is not None:
                at = known if self.size[known] == self.size[at] + 1 else self._split(at, word, known)
                continue
            new, back = self._state(self.size[at] + 1, 0, {}), at
            while back >= 0 and word not in self.next[back]:
                self.next[back][word] = new
                back = self.link[back]
            if back >= 0:
                known = self.next[back][word]
                self.link[new] = known if self.size[known] == self.size[back] + 1 else self._split(back, word, known)
            at = new

    def finish(self, items: list[tuple]) -> None:
        """Note for each state which items' windows its strings hold."""
        self.level = [-1] * len(self.next)  # the suffix state whose strings include one of the window's length
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            if self.size[state] >= self.window:
                up = self.link[state]
                self.level[state] = state if self.size[up] < self.window else self.level[up]
        for item, sequence in items:
            state = 0
            for k, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if k >= self.window:
                    self.items[self.level[state]].add(item)
            if 0 < len(sequence) < self.window:
                self.short[state].append((len(sequence), item))
        self.shorter = [-1] * len(self.next)  # the nearest suffix state, itself included, that a short item ends in
        for state in sorted(range(len(self.next)), key=self.size.__getitem__):
            self.shorter[state] = state if state in self.short else self.shorter[self.link[state]] if state else -1

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(first word, number of words) of the windows that occur, and their items."""
        after, link, size, level, shorter = self.next, self.link, self.size, self.level, self.shorter
        state = length = 0
        hits, items = [], set()
        for k, word in enumerate(words, 1):
            while state and word not in after[state]:
                state = link[state]
                length = size[state]
            known = after[state].get(word)
            if known is None:
                length = 0
                continue
            state, length = known, length + 1
            if length >= self.window:
                hits.append((k - self.window, self.window))
                items |= self.items[level[state]]
            up = shorter[state]
            while up >= 0:
                for n, item in self.short[up]:
                    if n <= length:
                        hits.append((k - n, n))
                        items.add(item)
                up = shorter[link[up]] if up else -1
        return hits, items


class Index:
    """An automaton with sorted hashes of its words and pairs of words, for numpy."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        data, offsets = kernels.buffers(pa.array([x[1] or "" for x in rows], pa.large_string()))
        data = kernels.LOWER[data]
        starts, ends, first = kernels.words(data, offsets, kernels.LETTERED)
        self.vocabulary, ids = np.unique(kernels.span_hashes(data, starts, ends), return_inverse=True)
        ids = ids.astype(np.int64)
        sequences = [(row[0], ids[a:b].tolist()) for row, a, b in zip(rows, first[:-1], first[1:], strict=True)]
        row = kernels.row_of(first)
        inner = row[1:] == row[:-1]
        self.pairs = np.unique((ids[:-1] * len(self.vocabulary) + ids[1:])[inner])
        self.least = min([window, *(len(s) for _, s in sequences if s)])
        self.automaton = Automaton(window)
        for _, sequence in sequences:
            self.automaton.add(sequence)
        self.automaton.finish(sequences)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.vocabulary & np.uint64((1 << 20) - 1)] = True

    def runs(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids (-1: in no item), and starts and ends of the runs that can hold a window."""
        ids = np.full(len(hashes), -1, np.int64)
        if not len(self.vocabulary) or not len(hashes):
            return ids, ids[:0], ids[:0]
        some = np.flatnonzero(self.near[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        ids[some] = np.where(self.vocabulary[at] == hashes[some], at, -1)
        if self.least == 1:
            inside = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
            return ids, edge[::2], edge[1::2]
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row[1:] == row[:-1]))
        pair = ids[both] * len(self.vocabulary) + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        joined = np.zeros(len(hashes) + 1, np.int8)
        joined[1 + both[self.pairs[at] == pair] if len(self.pairs) else []] = 1  # at k + 1: words k and k + 1 occur together
        edge = np.flatnonzero(np.diff(np.concatenate((joined, [0]))))
        starts, ends = edge[::2], edge[1::2] + 1
        long = ends - starts >= self.least
        return ids, starts[long], ends[long]


def _kernel(broadcast):
    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        index = broadcast.value
        data = kernels.LOWER[data]
        starts, ends, first = kernels.words(data, offsets, kernels.LETTERED)
        hashes = kernels.span_hashes(data, starts, ends)
        row = kernels.row_of(first)
        ids, a, b = index.runs(hashes, row)
        hit, items = np.zeros(len(hashes), bool), defaultdict(set)
        for low, high in zip(a.tolist(), b.tolist(), strict=True):
            cuts = [low, *(first[row[low] + 1 : row[high - 1] + 1]).tolist(), high]  # a run of single words may cross rows
            for x, y in zip(cuts, cuts[1:], strict=False):
                found, names = index.automaton.stream(ids[x:y].tolist())
                for k, n in found:
                    hit[x + k : x + k + n] = True
                if found:
                    items[int(row[x])] |= names
        spans: list = [[] for _ in range(len(offsets) - 1)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while low < high:
                r = int(row[low])
                end = min(high, int(first[r + 1]))
                spans[r].append((low - int(first[r]), end - int(first[r]), int(starts[low] - offsets[r]), int(ends[end - 1] - offsets[r])))
                low = end
        return [np.diff(first), [[{"first_word": s[0], "end_word": s[1], "first_byte": s[2], "end_byte": s[3]} for s in x] for x in spans], [sorted(i for i in items[k] if i is not None) if k in items else [] for k in range(len(offsets) - 1)]]

    return kernel


FIELDS = "n_words long, spans array<struct<first_word: int, end_word: int, first_byte: int, end_byte: int>>, items array<long>"


def pieces(benchmark: DataFrame, window: int, most_words: int) -> DataFrame:
    """item_id and text of the items; those that may have over ``most_words`` words are cut into pieces that overlap."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    step = max(1, most_words - window + 1)
    words = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - window), F.lit(step))
    cut = F.transform(first, lambda k: F.array_join(F.slice(words, k + 1, step + window - 1), " "))
    long = F.octet_length("text") > most_words  # a word has a byte at least
    return rows.withColumn("text", F.explode_outer(F.when(long, cut).otherwise(F.array("text"))))


def shards(items: DataFrame, most_words: int) -> list:
    """Filters that deal the pieces over automata of bounded size by a hash of their text."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (most_words * 5)))
    return [F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``carry`` and the text) with n_words, the hit spans and the ids of the items found."""
    carry = [*(docs.columns if carry is None else carry)]
    items = pieces(benchmark, window, most_words)
    parts = shards(items, most_words)
    last, out = len(parts) - 1, None
    for k, part in enumerate(parts):
        rows = [(x[0], x[1]) for x in items.where(part).collect()]
        broadcast = docs.sparkSession.sparkContext.broadcast(Index(rows, window))
        before = out
        source = docs if before is None else before.withColumn("text", F.col("row")["text"])
        out = map_texts(source, _kernel(broadcast), FIELDS, [*dict.fromkeys([*carry, *(["text"] if last else [])])] if k == 0 else ["row", "spans", "items"])
        if k:
            same = F.array_distinct(F.concat(F.col("row")["items"], "items"))
            out = out.select(F.col("row")["row"].alias("row"), "n_words", _joined(F.concat(F.col("row")["spans"], "spans")).alias("spans"), F.array_sort(same).alias("items"))
        if k < last:
            out = saved(out, "scanned")
            broadcast.destroy()
            if before is not None:
                dropped(before)
    return out


def _joined(spans):
    """Spans of words as the fewest that cover the same words."""
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first_word"].alias("first_word"), F.greatest(last(acc)["end_word"], s["end_word"]).alias("end_word"), last(acc)["first_byte"].alias("first_byte"), F.greatest(last(acc)["end_byte"], s["end_byte"]).alias("end_byte"))))
    none = F.slice(spans, 1, 0)
    return F.aggregate(F.array_sort(spans), none, lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["end_word"] >= s["first_word"]), longer(acc, s)).otherwise(F.concat(acc, F.array(s))))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end_word"] - s["first_word"]).cast("long"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.select(F.col("row")["doc_id"].alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED) -> DataFrame:
    """The documents without the words that a window hits; those of which more than ``most_covered`` is hit go whole."""
    scanned = scan(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + (s["end_word"] - s["first_word"]))
    raw = F.col("row")["text"].cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end_byte"]))
    starts = F.concat(F.transform("spans", lambda s: s["first_byte"]), F.array(F.octet_length(raw)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    text = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("row")["text"])
    kept = scanned.where(hit <= F.col("n_words") * most_covered)
    return kept.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same as the digest of a scan of documents, in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
it AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], chr(31)) AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM it)),
sizes AS (SELECT DISTINCT n FROM it),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], chr(31)) AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS nh FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
nm AS (SELECT doc_id, count(DISTINCT item_id) AS ni, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(nh, 0) AS n_hit, coalesce(ni, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(nh, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN nm USING (doc_id)
"""
