"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import evaluation as V
from textloom.plans.registry import literal_sql, query, table

_J = "j AS (SELECT lang, d.doc_id, len(text) - len(replace(text, '|', '')) + len(text) - len(replace(text, '!!', '')) > 8 AS said, quality = 0 AS truth, toxic, quality, n_chars FROM documents d JOIN labels USING (doc_id))"


def judged(spark, d):
    bars = lambda x: F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars", (bars("|") + bars("!!") > 8).alias("said")).join(table(spark, d, "labels"), "doc_id").select("*", (F.col("quality") == 0).alias("truth"))


@query("rule_scores", f"WITH {_J}, g AS (SELECT lang, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn FROM j GROUP BY ROLLUP (lang)), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM g) SELECT lang, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p")
def _(spark, d):
    return V.rule_scores(judged(spark, d), "lang", "said", "truth")


@query("grouping_sets", f"WITH {_J} SELECT lang, quality, count(*) AS n FROM j GROUP BY GROUPING SETS ((lang), (quality), ())")
def _(spark, d):
    return judged(spark, d).groupingSets([["lang"], ["quality"], []], "lang", "quality").agg(F.count("*").alias("n"))


@query("wilson_interval", f"WITH {_J}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM j GROUP BY lang), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM g) SELECT lang, n, k, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM z")
def _(spark, d):
    g = judged(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("calibration", f"WITH {_J}, q AS (SELECT lang, quality AS y, n_chars / (n_chars + 400.0) AS p FROM j), b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y, sum((p - q.y) ** 2) AS sq, count(*) FILTER ((p >= 0.5) = (q.y = 1)) AS ok FROM q GROUP BY ALL), g AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, sum(ok) AS k, sum(sq) AS sq, sum(n * abs(p - y)) AS gap, 1.959963984540054 AS z FROM b GROUP BY lang) SELECT lang, n, round(k / n, 6) AS accuracy, round(greatest(0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high, round(sq / n, 6) AS brier, round(gap / n, 6) AS ece FROM g".replace("avg(p) AS p, avg(y) AS y, sum((p - q.y) ** 2) AS sq", "avg(q.p) AS p, avg(q.y) AS y, sum((q.p - q.y) ** 2) AS sq").replace("least(floor(p * 10), 9)", "least(floor(q.p * 10), 9)").replace("FILTER ((p >= 0.5)", "FILTER ((q.p >= 0.5)"))
def _(spark, d):
    rows = judged(spark, d).select("lang", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 400.0)).alias("p"))
    return V.calibration(rows, "lang", "p", "y")


@query("paired_interval", f"WITH {_J} SELECT lang, count(*) AS n, round(avg(quality - toxic), 6) AS mean, round(avg(quality - toxic) - 1.96 * stddev_samp(quality - toxic) / sqrt(count(*)), 6) AS low, round(avg(quality - toxic) + 1.96 * stddev_samp(quality - toxic) / sqrt(count(*)), 6) AS high FROM j GROUP BY lang")
def _(spark, d):
    return V.paired_interval(judged(spark, d).select("lang", (F.col("quality") - F.col("toxic")).alias("delta")), "lang", "delta")


@query("holdout_slices", f"WITH {_J} SELECT lang, count(*) AS n FROM j GROUP BY lang HAVING count(*) >= 50")
def _(spark, d):
    return judged(spark, d).groupBy("lang").agg(F.count("*").alias("n")).where("n >= 50")


@query("p95", "SELECT event_type, quantile_disc(CAST(value AS DOUBLE), 0.95) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("axis_ranker", f"WITH {_J} SELECT doc_id, round(1 / (1 + exp(-4 * (n_chars / 1000.0 - toxic))), 6) AS p FROM j")
def _(spark, d):
    return judged(spark, d).select("doc_id", F.round(X.logistic(4 * (F.col("n_chars") / 1000.0 - F.col("toxic"))), 6).alias("p"))


_E = [("c1", 1, "r", 1, 3), ("c1", 2, "r", 2, 5), ("c1", 3, "s", 1, 1), ("c2", 1, "r", 9, 9)]
_F = [("c1", 1, "r", 2, 2), ("c1", 2, "r", 3, 4), ("c1", 3, "s", 4, 4), ("c2", 1, "s", 9, 9)]


@query("expectation_matches", f"SELECT * FROM {literal_sql([('c1', 1, 1), ('c1', 2, 2)], 'case_, expectation, finding')} AS x")
def _(spark, d):
    s = "case_ string, id long, rule string, start_line long, end_line long"
    return V.greedy_matches(spark.createDataFrame(_E, s), spark.createDataFrame(_F, s))


_B = [("en", 0.1, 0.1), ("de", 1.0, 0.99), ("xx", 0.5, 0.5)]


@query("baseline_gate", f"WITH {_J}, g AS (SELECT lang AS rule, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn FROM j GROUP BY lang), p AS (SELECT rule, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS p, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS r FROM g), b AS {literal_sql(_B, 'rule, bp, br')} SELECT b.rule, CAST(bp AS DOUBLE) AS base_precision, p AS precision, CAST(br AS DOUBLE) AS base_recall, r AS recall FROM b LEFT JOIN p USING (rule) WHERE p IS NULL OR p < bp - 1e-4 OR r < br - 1e-4")
def _(spark, d):
    scores = V.rule_scores(judged(spark, d), "lang", "said", "truth").where("lang IS NOT NULL").withColumnRenamed("lang", "rule").select("rule", "precision", "recall")
    return V.regressions(scores, spark.createDataFrame(_B, "rule string, precision double, recall double"))
