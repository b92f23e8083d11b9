"""Evaluation: matching findings to expectations, precision and recall, intervals, calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


def rule_scores(pairs: DataFrame, rule: str, said: str, truth: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each rule and, with a null rule, over all; 0 / 0 is 1."""
    one = lambda c: F.count_if(c)
    g = pairs.rollup(rule).agg(one(F.col(said) & F.col(truth)).alias("tp"), one(F.col(said) & ~F.col(truth)).alias("fp"), one(~F.col(said) & F.col(truth)).alias("fn"))
    part = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    p, r = part(F.col("tp"), F.col("fp")), part(F.col("tp"), F.col("fn"))
    return g.select(rule, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"))


def greedy_matches(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """case_, expectation, finding: expectations in order each take the first finding not yet taken with the same rule
    and overlapping lines. expectations: case_, id, rule, start_line, end_line; findings likewise."""

    def run(_, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        f = f.sort_values("id")
        for x in e.sort_values("id").itertuples():
            ok = f[(f.rule == x.rule) & (f.start_line <= x.end_line) & (x.start_line <= f.end_line) & ~f.id.isin(taken)]
            if len(ok):
                taken.add(ok.id.iloc[0])
                out.append((x.case_, x.id, ok.id.iloc[0]))
        return pd.DataFrame(out, columns=["case_", "expectation", "finding"])

    return expectations.groupBy("case_").cogroup(findings.groupBy("case_")).applyInPandas(run, "case_ string, expectation long, finding long")


def calibration(rows: DataFrame, group: str, p: str, y: str, bins: int = 10) -> DataFrame:
    """n, accuracy with its interval, Brier score and expected calibration error over equal-width bins of each group."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cell = rows.groupBy(group, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"), F.sum(F.when((F.col(p) >= 0.5) == (F.col(y) == 1), 1).otherwise(0)).alias("right"))
    g = cell.groupBy(group).agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("sq").alias("sq"), F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))).alias("gap"))
    low, high = X.wilson(F.col("right"), F.col("n"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select(group, "n", r(F.col("right") / F.col("n"), "accuracy"), r(low, "low"), r(high, "high"), r(F.col("sq") / F.col("n"), "brier"), r(F.col("gap") / F.col("n"), "ece"))


def paired_interval(rows: DataFrame, group: str, delta: str) -> DataFrame:
    """Mean of paired differences with its 95 % interval."""
    g = rows.groupBy(group).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("s"))
    half = 1.96 * F.coalesce("s", F.lit(0.0)) / F.sqrt("n")
    return g.select(group, "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


def regressions(scores: DataFrame, baseline: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """Rules whose precision or recall fell below the baseline by more than epsilon; missing rules too."""
    j = baseline.toDF("rule", "base_precision", "base_recall").join(scores, "rule", "left")
    bad = F.col("precision").isNull() | (F.col("precision") < F.col("base_precision") - epsilon) | (F.col("recall") < F.col("base_recall") - epsilon)
    return j.where(bad).select("rule", "base_precision", "precision", "base_recall", "recall")
