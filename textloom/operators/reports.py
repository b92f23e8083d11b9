"""Sinks: text, JSON, SARIF and DOT documents, edits applied to texts, unified diffs, atomic writes, baselines.

Documents for people are bounded by what people read, so their last step is one row by design; row-wise sinks (JSON
lines, baselines, caches) stay distributed.
"""

import difflib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_report(findings: DataFrame) -> DataFrame:
    """path, report: the findings of a file as lines, in order of line and rule."""
    line = F.format_string("%s:%d %s", F.col("path"), F.col("line"), F.col("rule"))
    return findings.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "rule", line.alias("text")))), lambda x: x["text"]), "\n").alias("report"))


def json_report(findings: DataFrame) -> DataFrame:
    """path, json: a document for each file."""
    return findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "rule"))).alias("findings")).select("path", F.to_json(F.struct("path", "findings")).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result object for each finding, as JSON."""
    level = F.when(F.col("severity") == "major", "error").when(F.col("severity") == "minor", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select("path", "line", "rule", F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif(findings: DataFrame) -> DataFrame:
    """One row: the whole log, with the distinct rules and their safety (``per-finding`` where it differs)."""
    rules = findings.groupBy("rule").agg(F.when(F.count_distinct("safety") == 1, F.min("safety")).otherwise("per-finding").alias("safety"))
    r = rules.agg(F.array_sort(F.collect_list(F.struct(F.col("rule").alias("id"), F.struct("safety").alias("properties")))).alias("rules"))
    f = sarif_results(findings).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "rule", "result"))), lambda x: x["result"]).alias("results"))
    head = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"textloom","rules":'), F.to_json("rules"), F.lit('}},"results":['), F.array_join("results", ","), F.lit("]}]}"))
    return r.crossJoin(f).select(head.alias("sarif"))


def dot(edges: DataFrame) -> DataFrame:
    """One row: a digraph, edges in order."""
    line = F.format_string('  "%s" -> "%s";', F.col("a"), F.col("b"))
    return edges.select(line.alias("x")).distinct().agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list("x")), "\n"), F.lit("\n}")).alias("dot"))


def edited(text: Column, splices: Column) -> Column:
    """A text with splices (start, end in characters, replacement) applied from right to left; overlapping ones, and those
    out of bounds, leave the text alone."""
    order = F.array_sort(splices, lambda a, b: (b["start"] - a["start"]).cast("int"))
    ok = F.forall(F.sequence(F.lit(1), F.size(order)), lambda k: (F.element_at(order, k)["start"] <= F.element_at(order, k)["end"]) & (F.element_at(order, k)["end"] <= F.when(k == 1, F.length(text)).otherwise(F.get(order, k - 2)["start"])))
    put = F.aggregate(order, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), s["replacement"], F.substring(t, (s["end"] + 1).cast("int"), F.length(t))))
    return F.when((F.size(splices) > 0) & ok, put).otherwise(text)


@F.pandas_udf(T.StringType())
def unified_diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    one = lambda p, a, b: "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}"))
    return pd.Series([one(*x) for x in zip(path, before, after, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))
def derived_edit(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The smallest single replacement that turns one text into the other, by common prefix and suffix."""

    def one(a: str, b: str) -> tuple[int, int, str]:
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        p = int(differ[0]) if len(differ) else n
        n -= p
        differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        s = int(differ[0]) if len(differ) else n
        return p, len(a) - s, b[p : len(b) - s]

    return pd.DataFrame([one(a or "", b or "") for a, b in zip(before, after, strict=True)], columns=["start", "end", "replacement"])


@F.pandas_udf(T.StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, in hexadecimal."""

    raw = [(t or "").encode() for t in text]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    longest = size[order]
    for k in range(int(longest[0]) if len(raw) else 0):  # the k-th byte of all texts that have one
        n = int(np.searchsorted(-longest, -k, "left"))
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), object)
    out[order] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out, index=text.index)


def _files(spark, path: str) -> tuple:
    P = spark._jvm.org.apache.hadoop.fs.Path
    return P, P(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def atomic_write(df: DataFrame, path: str) -> None:
    """Write beside the target, then put it in place by renames; the version before is kept as ``path.before`` for undoing.
    A reader never finds half a table, though for a moment between the renames none; at any time one whole version
    is there, at ``path`` or at ``path.before``, and ``undo`` puts the latter in place after a crash."""
    P, fs = _files(df.sparkSession, path)
    fresh, stale = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if fs.exists(P(path)):
        if fs.exists(P(path + ".before")):
            fs.rename(P(path + ".before"), P(stale))
        fs.rename(P(path), P(path + ".before"))
    if not fs.rename(P(fresh), P(path)):
        raise OSError(f"{fresh} could not be moved to {path}")
    fs.delete(P(stale), True)


def undo(spark, path: str) -> bool:
    """Put the version before the last atomic write back."""
    P, fs = _files(spark, path)
    if not fs.exists(P(path + ".before")):
        return False
    gone = f"{path}.{uuid.uuid4().hex}"
    if fs.exists(P(path)):
        fs.rename(P(path), P(gone))
    done = bool(fs.rename(P(path + ".before"), P(path)))
    fs.delete(P(gone), True)
    return done
