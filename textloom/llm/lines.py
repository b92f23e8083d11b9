"""Line dedup by the spread of lines over sites.

Each line's 64-bit hash (of the line without white space at its ends) gathers a HyperLogLog sketch of the sites it
occurs on, merged by aggregation from partial sketches, so a line of a third of all documents costs one small row for
each task. A sketch settles lines whose estimate is far from ``min_sites``; those within ``margin`` of it get an exact
distinct count. Lines on at least ``min_sites`` sites are boilerplate: the first one (smallest doc_id, then line)
stays and the others are cut from their texts with their line feeds.

The lines found go to the executors as one broadcast table while they are at most ``most_lines`` (20 bytes a line). Beyond
that only the most frequent of them do, as many powers of two of frequency as fit; the others, each of which is on few
rows, meet the texts' own lines by a join on the hash that moves hashes and line numbers, not texts, and come back as a
list of line numbers for each (doc_id, digest of the text). So the texts are read once and rewritten never, however many
lines are found, and the join has no hot key among the lines, as hot ones are those that were broadcast.

Cases: a null text stays null and an empty one empty, and a document that loses every line keeps an empty text; blank
lines are never counted or cut; a null source is a site of its own; lines of rows with a null doc_id come after all
others; of rows that repeat the smallest id of a line, all keep it; an empty table gives an empty table; other columns
pass through whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import saved
from textloom.llm.texts import map_texts, named

MIN_SITES = 10
#: 2 ** LG_K registers: a standard error of 0.8 / 2 ** (LG_K / 2), here 2 %.
LG_K = 11
#: Estimates within this part of ``min_sites`` are near it: over six standard errors.
MARGIN = 0.15
MOST_LINES = 500_000
_BLANK = b"\t\n\x0b\x0c\r "
_LAST = (1 << 63) - 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, then doc_id, number and hash of each line that is not blank."""
    lines = docs.select(*columns, _id().alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    lines = lines.withColumn("body", F.btrim("body", F.lit(_BLANK.decode()))).where("body <> ''")
    return lines.withColumn("hash", F.xxhash64("body")).drop("body")


def spread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """hash, doc_id and line of the first occurrence, and number of occurrences ``n``, of each line on at least
    ``min_sites`` distinct sites."""
    lines = _lines(docs, F.xxhash64(F.col("source").isNull(), "source").alias("site")).select("hash", "site", F.struct("doc_id", "line").alias("at"))
    sketches = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("at").alias("first"), F.count("*").alias("n"))
    likely = saved(sketches.where(F.col("sites") >= min_sites * (1 - MARGIN)), "lines")
    near = likely.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("hash")
    if near.isEmpty():
        return likely.select("hash", "first.doc_id", "first.line", "n")
    exact = lines.select("hash", "site").join(near, "hash", "left_semi").distinct().groupBy("hash").agg(F.count("*").alias("exact"))
    found = likely.join(exact, "hash", "left").where(F.coalesce("exact", "sites") >= min_sites)
    return found.select("hash", "first.doc_id", "first.line", "n")


def _hot(found: DataFrame, most_lines: int) -> int:
    """The least power of two such that at most ``most_lines`` of the lines found occur that often or more."""
    counts = {r["power"]: r["lines"] for r in found.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("lines")).collect()}
    sums = accumulate(counts.get(power, 0) for power in range(63, -1, -1))
    return min((power for power, lines in zip(range(63, -1, -1), sums, strict=True) if lines <= most_lines), default=63)


def _cold_cuts(docs: DataFrame, cold: DataFrame) -> DataFrame:
    """id, digest of the text, and the numbers ``gone`` of its lines that are among ``cold``, but the first occurrences."""
    first = cold.select("hash", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    at = _lines(docs, _digest().alias("digest")).join(first, "hash").where("first_doc <> doc_id OR first_line <> line")
    return at.groupBy(F.col("doc_id").alias("id"), "digest").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _kernel(broadcast):
    def kernel(data: np.ndarray, offsets: np.ndarray, ids: pa.Array, before: pa.Array) -> list:
        hashes, docs, lines = broadcast.value
        out = []
        for k, (doc, gone) in enumerate(zip(ids.to_pylist(), before.to_pylist(), strict=True)):
            body = data[offsets[k] : offsets[k + 1]].tobytes()
            parts = body.split(b"\n")
            found = np.zeros(len(parts), bool)
            if len(hashes):
                trimmed = [p.strip(_BLANK) for p in parts]
                own = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in trimmed), np.uint64, len(parts)).view(np.int64)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                found = (hashes[at] == own) & ((docs[at] != doc) | (lines[at] != np.arange(len(own))))
                found &= np.fromiter(map(bool, trimmed), bool, len(parts))
            found[gone] = True
            cut = np.flatnonzero(found)
            if len(cut):
                body = b"\n".join(p for p, g in zip(parts, found.tolist(), strict=True) if not g)
            out.append((body, len(parts), cut))
        texts, n, cuts = zip(*out, strict=True)
        return [pa.array(texts, pa.large_binary()).view(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))]

    return kernel


FIELDS = "text string, n_lines long, cut array<int>"


def cut(docs: DataFrame, min_sites: int = MIN_SITES, most_lines: int = MOST_LINES, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``carry``; by default all but the text), ``text`` without boilerplate lines (never null),
    n_lines before, and ``cut``, the numbers of the lines cut."""
    found = saved(spread(docs, min_sites), "spread")
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    rows = docs.select(F.struct(*[named(c) for c in carry]).alias("row"), "text", _id().alias("id"))
    hot = F.floor(F.log2("n")) >= _hot(found, most_lines)
    cold = found.where(~hot)
    if cold.isEmpty():
        rows = rows.withColumn("gone", F.array().cast("array<int>"))
    else:
        rows = rows.withColumn("digest", _digest()).join(_cold_cuts(docs, cold), ["id", "digest"], "left")
    table = found.where(hot).select("hash", "doc_id", "line").toArrow().combine_chunks().sort_by("hash")
    lookup = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("hash", "doc_id", "line")))
    out = map_texts(rows, _kernel(lookup), FIELDS, ["row"], also=[F.col("id"), F.coalesce("gone", F.array().cast("array<int>"))])
    return out.select("row.row", "text", "n_lines", "cut")


def dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with boilerplate lines cut; every row stays."""
    out = cut(docs, min_sites, carry=docs.columns)
    text = F.when(F.col("row")["text"].isNotNull(), F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
t AS (SELECT *, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM l),
s AS (
  SELECT body, min(struct_pack(d := coalesce(doc_id, 9223372036854775807), n := line)) AS first FROM t WHERE body <> ''
  GROUP BY body HAVING count(DISTINCT coalesce('s' || source, 't')) >= 10),
m AS (SELECT t.*, s.body IS NOT NULL AND (s.first.d <> t.doc_id OR s.first.n <> t.line) AS gone FROM t LEFT JOIN s USING (body))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_cut, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 1, 0, '' FROM documents WHERE text IS NULL
"""
