"""Metrics of regions: information, complexity, peer-relative statistics, burden, outliers, hotspots and roll-ups.

A region is any set of tokens with a key. Statistics over all regions are aggregates joined back as one broadcast row,
so no window spans the whole table except ranks that are asked for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.graphs import kept


def entropy(counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """tokens, vocabulary, entropy in bits, entropy over log2(vocabulary), and volume of each key's counts."""
    total = counts.groupBy(*keys).agg(F.sum(count).alias("tokens"), F.count("*").alias("vocabulary"), F.sum(F.col(count) * F.log2(count)).alias("s"))
    bits = F.log2("tokens") - F.col("s") / F.col("tokens")
    clean = F.greatest(F.lit(0.0), bits)
    norm = F.when(F.col("vocabulary") <= 1, 0.0).otherwise(F.least(F.lit(1.0), clean / F.log2("vocabulary")))
    return total.select(*keys, F.col("tokens").cast("long").alias("tokens"), "vocabulary", F.round(clean, 6).alias("entropy"), F.round(norm, 6).alias("normalized"), F.round(clean * F.col("tokens"), 4).alias("volume"))


def byte_entropy(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Entropy of each text's bytes, by a histogram in numpy."""
    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        import numpy as np

        def one(t: str | None) -> float:
            if not t:
                return 0.0
            c = np.bincount(np.frombuffer(t.encode(), np.uint8))
            p = c[c > 0] / c.sum()
            return float(-(p * np.log2(p)).sum())

        return texts.map(one)

    return docs.select(key, F.round(bits(text), 6).alias("byte_entropy"))


def halstead(tokens: DataFrame, keys: list[str], operators: list[str]) -> DataFrame:
    """n1, n2, N1, N2, volume, difficulty and effort; operators are those listed, all else that is code is an operand."""
    is_op = F.col("token").isin(operators)
    g = tokens.groupBy(*keys).agg(
        F.count_distinct(F.when(is_op, F.col("token"))).alias("n1"), F.count_distinct(F.when(~is_op, F.col("token"))).alias("n2"), F.count_if(is_op).alias("N1_"), F.count_if(~is_op).alias("N2_")
    )
    n = F.col("n1") + F.col("n2")
    volume = F.when(n > 0, (F.col("N1_") + F.col("N2_")) * F.log2(n)).otherwise(0.0)
    difficulty = F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("N2_") / F.col("n2")).otherwise(0.0)
    return g.select(*keys, "n1", "n2", F.col("N1_").alias("total_operators"), F.col("N2_").alias("total_operands"), F.round(volume, 4).alias("volume"), F.round(difficulty, 4).alias("difficulty"), F.round(volume * difficulty, 2).alias("effort"))


def robust_z(rows: DataFrame, group: list[str], value: str, least: int = 8) -> DataFrame:
    """median, MAD and (x - median) / (1.4826 MAD) where a group has at least ``least`` rows and MAD is not 0. A null is a group
    of its own; rows without a value have no z; medians go by ranges, so no task holds a hot group's values."""
    rows = rows.withColumn("_group", F.struct(*group))
    middle = kept(group_quantiles(rows, ["_group"], value, [0.5]).toDF("_group", "peers", "median"))
    with_middle = rows.join(middle, "_group", "left").withColumn("peers", F.coalesce("peers", F.lit(0)))
    away = with_middle.select("_group", F.abs(F.col(value) - F.col("median")).alias("away"))
    mad = group_quantiles(away, ["_group"], "away", [0.5]).drop("count").toDF("_group", "mad")
    z = F.when((F.col("peers") >= least) & (F.col("mad") > 1e-12), (F.col(value) - F.col("median")) / (1.4826 * F.col("mad")))
    return with_middle.join(mad, "_group", "left").withColumn("z", F.round(z, 6)).withColumn("excess", F.round(F.greatest(F.lit(0.0), z), 6)).drop("_group")


def midrank_percentiles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Mid-rank percentiles without a single-task window: distinct values are counted first, and only they are ranked."""
    counts = cumulated(rows.groupBy(value).agg(F.count("*").alias("peers")), value, "peers")
    pct = F.when(F.col("count") <= 1, 0.5).otherwise((2 * F.col("before") + F.col("peers") - 1) / 2 / (F.col("count") - 1))
    return rows.join(counts, value).select(key, value, F.round(pct, 6).alias("percentile"))


def cumulated(counts: DataFrame, value: str, n: str, group: str | None = None) -> DataFrame:
    """``counts`` (values with their numbers) with ``before``, the number at smaller values, and ``count``, that of all; or, with
    a column ``group`` that is never null (a struct may hold nulls), those of the row's group. Values are dealt over ranges,
    summed within each, and the sums of the ranges before are added; of these there is a row for each range and group in it."""
    by = [group] if group else []
    ranges = kept(counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy(*by).orderBy("range")
    sums = ranges.groupBy("range", *by).agg(F.sum(n).alias("s")).select("range", *by, F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("count"))
    own = F.sum(n).over(Window.partitionBy("range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.join(sums if group else F.broadcast(sums), ["range", *by]).select(*counts.columns, (F.col("base") + F.coalesce(own, F.lit(0))).alias("before"), "count")


def group_quantiles(rows: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """The group's columns, ``count`` of its values and its linear quantiles, named ``q`` and their place. Distinct values are
    counted and cumulated over ranges of (group, value); no task holds a group, and only the two values about each quantile
    are gathered. Nulls are no values, and a group without any has no row; a null in ``group`` is a group of its own."""
    kinds = [F.col("_g").getField(c).alias(c) for c in group]
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*group).alias("_g"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    counts = cumulated(counts, "x", "n", "_g")
    place = [F.lit(q) * (F.col("count") - 1) for q in at]
    inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    picks = [F.max(F.when(inside(f(p)), F.col("x"))).alias(f"{name}{j}") for j, p in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))]
    one = counts.groupBy("_g").agg(F.max("count").alias("count"), *picks)
    part = lambda j: place[j] - F.floor(place[j])
    return one.select(*kinds, "count", *[(F.col(f"low{j}") + (F.col(f"high{j}") - F.col(f"low{j}")) * part(j)).alias(f"q{j}") for j in range(len(at))])


def quantiles(rows: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """One row: linear quantiles of each column, named ``column_q``, of all columns in one pass: values go by (column, value)."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("pair")).select("pair.*")
    found = group_quantiles(pairs, ["column"], "x", at)
    picks = [F.max(F.when(F.col("column") == c, F.col(f"q{j}"))).alias(f"{c}_{q}") for c in columns for j, q in enumerate(at)]
    return found.agg(*picks)


def burden(rows: DataFrame) -> DataFrame:
    """Heuristic burden of regions with cognitive, cyclomatic, max_nesting, tokens, token_entropy, structural_entropy,
    information_volume, nodes and nloc."""
    c, s = F.col, X.saturating
    complexity = 0.50 * s(c("cognitive"), 10.0) + 0.30 * s(F.greatest(c("cyclomatic") - 1, F.lit(0.0)), 8.0) + 0.20 * s(c("max_nesting"), 4.0)
    support = s(c("nodes"), 32.0)
    rows = rows.withColumn("complexity_burden", complexity).withColumn("information_burden", s(c("information_volume"), 512.0))
    disorder = c("structural_entropy") * support * c("complexity_burden")
    rows = rows.withColumn("entropy_burden", 0.60 * (1 - c("token_entropy")) * s(c("tokens"), 16.0) + 0.40 * disorder)
    rows = rows.withColumn("interaction_burden", c("complexity_burden") * (0.65 * c("information_burden") + 0.35 * c("structural_entropy")))
    total = 0.45 * c("complexity_burden") + 0.20 * c("information_burden") + 0.15 * c("entropy_burden") + 0.20 * c("interaction_burden")
    clamp = lambda x, high=1.0: F.greatest(F.lit(0.0), F.least(F.lit(high), x))
    measured = clamp(0.20 + 0.45 * s(c("tokens"), 32.0) + 0.30 * support, 0.95)
    size = F.greatest(s(c("tokens"), 64.0), s(c("nloc"), 20.0))
    return rows.withColumn("burden", F.round(clamp(clamp(total) * (0.50 + size)) * measured, 6))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, median, population stddev, extremes, quartiles, whether flat, whether outliers may be told."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.col(value), F.lit(0.0))))
    values = kept(rows.select(v.alias("v")))
    one = values.agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("low"), F.max("v").alias("high"))
    one = one.crossJoin(F.broadcast(quantiles(values, ["v"], [0.5, 0.25, 0.75]).toDF("median", "p25", "p75")))
    flat = (F.col("count") < 2) | (F.col("high") - F.col("low") < 0.05) | (F.col("stddev") < 0.01)
    return one.withColumn("flat", flat).withColumn("eligible", ~F.col("flat") & (F.col("count") >= 8))


def outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Regions at least one deviation above the mean and in the highest tenth, ranked."""
    d = distribution(rows, value).select("mean", "stddev", "eligible", "count")
    ranked = midrank_percentiles(rows.select(key, value), value, key)
    z = (F.col(value) - F.col("mean")) / F.col("stddev")
    out = ranked.crossJoin(F.broadcast(d)).where("eligible").withColumn("z", F.round(z, 6)).where("z >= 1 AND percentile >= 0.9")
    # higher values first, then by key: places over ranges of both, so equal values are no task of their own
    placed = cumulated(out.select(key, value, "z", "percentile").withColumn("_at", F.struct((-F.col(value)).alias("down"), F.col(key).alias("key"))).withColumn("_one", F.lit(1)), "_at", "_one")
    return placed.select(key, value, "z", "percentile", (F.col("before") + 1).cast("int").alias("rank"))


def hotspots(rows: DataFrame, key: str, high: list[str], low: list[str], sigma: float = 2.0, tokens: str = "tokens") -> DataFrame:
    """Regions beyond median +- sigma deviations in any metric; the score adds their z, low ones count from 16 tokens."""
    rows = kept(rows.select(key, *dict.fromkeys([*high, *low, tokens])))
    middle = quantiles(rows, high + low, [0.5]).toDF(*[f"{c}_m" for c in high + low])
    one = rows.agg(*[F.stddev_pop(c).alias(f"{c}_s") for c in high + low]).crossJoin(F.broadcast(middle))
    rows = rows.crossJoin(F.broadcast(one))
    marks = []
    for c, sign in [(c, 1) for c in high] + [(c, -1) for c in low]:
        z = sign * (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")
        ok = (F.col(f"{c}_s") > 0) & (z >= sigma)
        marks.append(F.when(ok if sign > 0 else ok & (F.col(tokens) >= 16), F.struct(F.lit(c + (" high" if sign > 0 else " low")).alias("reason"), z.alias("z"))))
    found = rows.select(key, F.array_compact(F.array(*marks)).alias("x")).where(F.size("x") > 0)
    score = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["z"])
    return found.select(key, F.round(score, 6).alias("score"), F.array_join(F.array_sort(F.col("x.reason")), ",").alias("reasons"))


def redundancy(regions: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines of each region that findings of a waste class cover, by class and over all, each line once.
    regions: path, region, start_line, end_line; findings: path, waste, start_line, end_line."""
    own = regions.select("path", "region", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    bad = findings.select("path", "waste", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    hit = own.join(bad, ["path", "line"]).groupBy("path", "region").agg(F.count_distinct("line").alias("lines"), *[F.count_distinct(F.when(F.col("waste") == w, F.col("line"))).alias(w) for w in ("clone", "pattern", "dead")])
    size = F.col("end_line") - F.col("start_line") + 1
    out = regions.join(hit, ["path", "region"], "left")
    return out.select("path", "region", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "clone", "pattern", "dead")], F.round(X.bounded_ratio(F.coalesce("lines", F.lit(0)), size), 6).alias("ratio"))


def dispersion(changes: DataFrame, keys: list[str], file: str, n: str) -> DataFrame:
    """How evenly changed lines spread over files: entropy over log2(files)."""
    return entropy(changes.where(F.col(n) > 0).groupBy(*keys, file).agg(F.sum(n).alias("n")), keys).select(*keys, F.col("tokens").alias("changed"), F.col("vocabulary").alias("files"), "normalized")


def transitions(events: DataFrame, owner: str, order: list[str], state: str) -> DataFrame:
    """owner, src, dst, n: steps from one state to the next."""
    w = Window.partitionBy(owner).orderBy(*order)
    return events.select(owner, F.col(state).alias("src"), F.lead(state).over(w).alias("dst")).where("dst IS NOT NULL").groupBy(owner, "src", "dst").agg(F.count("*").alias("n"))
