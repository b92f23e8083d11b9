"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

A source's target is its weight's share of all words, held to ``most_epochs`` times what the source has; what it
cannot give is shared again by weight. Within a source, documents follow one another in the order of a hash of their
id, pass after pass, so each takes up an interval of the source's cumulative demand. The source's weight changes over
the training time t in [0, 1] as ``1 + slope * (2 t - 1)``; that schedule is integrated in closed form, and inverting
the integral turns the start of a document's interval into its training position, in each pass that takes it: pass p
starts ``p * source_size`` words further on. Documents are range-sorted by their positions.

A hot source is never one group: its documents are dealt over 4096 hash buckets, sums of buckets are prefix-summed,
and running sums within buckets are added.

Cases: null text or text without words has size 0 and takes 0; a null source is a source of its own, ranked last; a
null ``doc_id`` is ordered by the hash of the empty string; equal ids are ordered by size and text hash, and rows
equal in all of these are interchangeable; an empty table gives an empty table; other columns are ignored, or carried
whole where ``carry`` names them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.storage import saved
from textloom.llm.texts import named

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Slopes of the schedules of sources in the same order, repeating: early, steady, late.
SLOPES = (-0.8, 0.0, 0.8)
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, the place of its skey from 0, nulls last: rows are dealt over ranges of skey, numbered
    within each, and the numbers of rows of the ranges before are added. Only those, one row a range, meet in a task."""
    order = (F.col("skey").isNull(), F.col("skey"))
    ranges = saved(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(F.broadcast(base), "range").select("*", (F.col("base") + own - 1).alias("rank")).drop("range", "base")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS, slopes: tuple = SLOPES) -> DataFrame:
    """``sizes`` (skey, source_size), one row for each source -> with target and slope. Water-filling: sources above
    their limit at the level of those that are not are set to it, until none is above; each round is one aggregation."""
    ranked = _ranked(sizes).select("skey", "source_size", _cycle(weights, F.col("rank")).cast("long").alias("w"), _cycle(slopes, F.col("rank")).alias("slope"), (F.col("source_size") * most_epochs).alias("cap"))
    ranked = saved(ranked, "sources")
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("w") > F.col("cap")
        x = ranked.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if x.n == capped or not x.w:
            break
        capped, level = x.n, (x.size - (x.held or 0)) / x.w
    return ranked.select("skey", "source_size", "slope", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS, slopes: tuple = SLOPES, carry: bool = False, passes: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), position (of the first pass;
    null where nothing is taken), range-sorted by position. With ``carry``, each row also has ``row``: all columns, and
    ``positions``: those of every pass. With ``passes``, a row stands for one pass over a document that the mix takes:
    it has ``pass`` in place of ``positions``, its own position, and the words that it gives in ``taken``."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # a prefix keeps nulls apart from every name and the order of code points
    skey = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source")))
    base = docs.select(F.coalesce(skey, F.lit("t")).alias("skey"), "doc_id", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("bucket"), *([F.struct(*[named(c) for c in docs.columns]).alias("row")] if carry else []))
    if not carry:
        base = saved(base, "sizes")  # words are counted once; whole rows are not written a further time for that
    sums = base.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    sources = targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, most_epochs, slopes)
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")).join(sources, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(sums, ["skey", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - full * F.col("source_size")).cast("long")
    taken = full * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    s = F.col("slope")

    def inverse(start: Column) -> Column:
        u = start / F.col("target")
        return F.when(s == 0, u).otherwise((s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * u)) / (2 * s))

    out = placed.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, inverse(F.col("start"))))
    more = ["row", "positions"] if carry else []
    if carry or passes:
        last = F.ceil(F.col("taken") / F.col("size")) - 1
        out = out.withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda p: inverse(F.col("start") + p * F.col("source_size")))))
    if passes:
        more = ["row", "pass"] if carry else ["pass"]
        out = out.select("*", F.posexplode("positions").alias("pass", "at"))
        out = out.withColumn("taken", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))).withColumn("position", F.col("at"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", *more).orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH base AS (
  SELECT coalesce('s' || source, 't') AS skey, doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY skey),
ranked AS (
  SELECT skey, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS w,
         CAST([-0.8, 0.0, 0.8][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS DOUBLE) AS slope, 3 * source_size AS cap
  FROM sizes),
leveled AS (
  SELECT *, CAST((SELECT sum(source_size) FROM ranked) - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
         / CAST((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (
  SELECT skey, source_size, slope, least(CAST(cap AS DOUBLE), w * (
    SELECT arg_min(level, CAST(cap AS DOUBLE) / w) FROM leveled WHERE level * w <= cap)) AS target
  FROM leveled),
placed AS (
  SELECT doc_id, size, source_size, target, slope,
         CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_passes
  FROM base JOIN sources USING (skey)),
took AS (
  SELECT *, full_passes * size + greatest(0, least(size, CAST(round(target - full_passes * source_size) AS BIGINT) - start)) AS taken,
         start / target AS u
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope) END END AS position
FROM took
"""
