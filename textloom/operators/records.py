"""Records about findings, revisions, evidence and runs: small relational operators that the larger ones are joined with."""

from __future__ import annotations

import json
import re


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

# fixed values: grammars by file ending
GRAMMARS = {".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript-jsx", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript-tsx", ".rs": "rust", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".jl": "julia"}
#: The longest lists of identifiers that go on.
MOST_DOMAIN, MOST_PREDICATE = 96, 64


def grammar(path: Column) -> Column:
    """The grammar of a path by its ending; null where there is none."""
    out = F.lit(None).cast("string")
    for ending, name in sorted(GRAMMARS.items(), key=lambda x: len(x[0])):
        out = F.when(F.lower(path).endswith(ending), name).otherwise(out)
    return out


def display_paths(findings: DataFrame, shown: DataFrame, path: str = "path") -> DataFrame:
    """Findings with ``display``, the path to show for theirs where ``shown`` (path, display) has one, else their own."""
    return findings.join(shown.select(F.col("path").alias(path), "display"), path, "left").withColumn("display", F.coalesce("display", F.col(path)))


def bounded_identifiers(names: Column, most: int = MOST_DOMAIN) -> Column:
    """The first ``most`` of a set of names in their order."""
    return F.slice(F.array_sort(F.array_distinct(names)), 1, most)


def maximal_texts(texts: Column) -> Column:
    """Those of an array of texts that no longer one contains."""
    return F.filter(texts, lambda x: ~F.exists(texts, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))


def utf16_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and UTF-16 column, both from 0, of a byte offset that falls between characters."""
    head = F.substring(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    last = F.element_at(F.split(head, "\n"), -1)
    return line, (F.octet_length(F.encode(last, "UTF-16BE")) / 2).cast("int")


def line_windows(text: Column, n: int = 5) -> Column:
    """The runs of n lines (fewer at the end) that begin at each line, joined by blanks."""
    lines = F.split(text, "\n")
    return F.transform(F.sequence(F.lit(1), F.size(lines)), lambda k: F.array_join(F.slice(lines, k, n), " "))


_MASK = re.compile(r"#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\[^\n]|[^'\\\n])*(?:'|\\?(?=\n)|\\?\Z)|\"(?:\\[^\n]|[^\"\\\n])*(?:\"|\\?(?=\n)|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)", re.S)


def masked(text: str) -> str:
    """A text whose strings and comments are blanks, every character and line at its place."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else masked(t))


def executable_text(text: Column | str) -> Column:
    """``masked`` of each text, in Arrow batches."""
    return F.pandas_udf(_masked, "string")(text)


def guard_facts(sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, fail_loud, identifiers, predicate_identifiers, features of the guards in each source, strings and comments left out.
    A guard that lets zero and NaN through within five lines carries ``nan-or-zero``. Identifiers are those with an
    underscore or a capital inside; at most 96 and 64 go on, the first in their order."""
    code = sources.select(key, executable_text(text).alias("code"))
    lines = F.split("code", "\n")
    names = lambda c: F.filter(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)(?!\s*\(|[A-Za-z0-9_])"), F.lit(1)), lambda t: t.rlike("_|[a-z][A-Z]"))
    compact = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    predicates = F.filter(lines, lambda x: compact(x).rlike(r"&&|\|\||==|!=|<=|>=|>0|0<|isfinite\(|isnan\(|iszero\(|^if|^assert"))
    code = code.withColumn("compact of code", compact(F.col("code")))  # a column, so that it is made once
    c = F.col("compact of code")
    # what no whole text has, none of its windows has: most need not be cut into windows
    both = F.when(c.contains("isnan(") & c.rlike(r"==0|0==|iszero\("), F.exists(line_windows(F.col("code")), lambda w: compact(w).rlike(r"==0|0==|iszero\(") & compact(w).rlike(r"isnan\(")))
    features = F.array_compact(F.array(
        F.when(c.contains("isfinite("), "finite"), F.when(c.contains("isnan("), "nan"), F.when(c.rlike(r"==0|0==|iszero\("), "zero"),
        F.when(c.rlike(r">0|0<"), "positive"), F.when(c.rlike(r"<=|>="), "bounded"), F.when(both, "nan-or-zero"),
    ))
    return code.select(key, F.col("code").rlike(r"(?i)\b(throw|error|raise|assert)\b").alias("fail_loud"), bounded_identifiers(names(F.col("code"))).alias("identifiers"), bounded_identifiers(F.flatten(F.transform(predicates, names)), MOST_PREDICATE).alias("predicate_identifiers"), features.alias("features"))


def graph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """a, b, change (added, removed, kept) of the edges of two graphs."""
    x = before.select("a", "b").distinct().withColumn("was", F.lit(True)).join(after.select("a", "b").distinct().withColumn("is", F.lit(True)), ["a", "b"], "full")
    return x.select("a", "b", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept").alias("change"))


def evidence(findings: DataFrame, facts: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """Findings with the numbers of outside facts that support and that conflict with them; those without any stay."""
    n = facts.groupBy(*keys).agg(F.count_if(F.col(verdict)).alias("supporting"), F.count_if(~F.col(verdict)).alias("conflicting"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return findings.join(n, keys, "left").select(*findings.columns, zero("supporting"), zero("conflicting"))


def confusion(rows: DataFrame, by: list[str], fired: str, wanted: str) -> DataFrame:
    """by, tp, fp, tn, fn, precision, recall, and the 95 % intervals' lower ends of both; a rate of nothing is null."""
    f, w = F.col(fired), F.col(wanted)
    g = rows.groupBy(*by).agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & ~w).alias("tn"), F.count_if(~f & w).alias("fn"))
    rate = lambda a, b: F.round(F.when(a + b > 0, a / (a + b)), 6)
    low = lambda a, b: F.round(F.when(a + b > 0, X.wilson(a, a + b)[0]), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("*", rate(tp, fp).alias("precision"), rate(tp, fn).alias("recall"), low(tp, fp).alias("precision_low"), low(tp, fn).alias("recall_low"))


def clustered(rows: DataFrame, by: list[str], cluster: str, fired: str, wanted: str) -> DataFrame:
    """``confusion`` of clusters: variants of one case count once, and one that any variant gets wrong is wrong."""
    right = F.bool_and(F.col(fired) == F.col(wanted))
    one = rows.groupBy(*by, cluster).agg(F.bool_or(wanted).alias("w"), right.alias("right"))
    return confusion(one.select(*by, F.when(F.col("right"), F.col("w")).otherwise(~F.col("w")).alias("f"), "w"), by, "f", "w")


def promoted(scores: DataFrame, least: DataFrame, by: str) -> DataFrame:
    """by, promoted, why: families whose precision reaches what is asked of them; one without a score or a fired case is not."""
    rows = least.join(scores, by, "left")
    why = F.when(F.col("tp").isNull(), "not scored").when(F.col("precision").isNull(), "never fired").when(F.col("precision") < F.col("least"), "precision too low")
    return rows.select(by, why.isNull().alias("promoted"), F.coalesce(why, F.lit("")).alias("why"))


def cases_equal(found: DataFrame, wanted: DataFrame, case: str, rule: str) -> DataFrame:
    """case, missing, extra, equal: whether each case has exactly the rules that it should, with how many differ."""
    f, w = found.select(case, rule).distinct().withColumn("f", F.lit(1)), wanted.select(case, rule).distinct().withColumn("w", F.lit(1))
    g = f.join(w, [case, rule], "full").groupBy(case).agg(F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"))
    return g.select(case, "missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("equal"))


def eligibility(needs: DataFrame, layers: DataFrame) -> DataFrame:
    """recipe, eligible, blocks: a recipe may run where all layers that it needs (recipe, layer) are complete in (layer, status)."""
    rows = needs.join(layers, "layer", "left").withColumn("block", F.when(F.col("status").isNull(), F.concat("layer", F.lit(": missing"))).when(F.col("status") != "complete", F.concat("layer", F.lit(": "), "status")))
    g = rows.groupBy("recipe").agg(F.array_sort(F.collect_set("block")).alias("b"))
    return g.select("recipe", (F.size("b") == 0).alias("eligible"), F.array_join("b", ", ").alias("blocks"))


def demotions(runs: DataFrame, recipe: str, failed: str, most: int = 3) -> DataFrame:
    """recipe, failures, demoted: negative memory; a recipe that failed ``most`` times or more is not proposed again."""
    g = runs.groupBy(recipe).agg(F.count_if(failed).alias("failures"))
    return g.select(recipe, "failures", (F.col("failures") >= most).alias("demoted"))


def remembered(memory: DataFrame, runs: DataFrame, recipe: str, failed: str, most: int = 3) -> DataFrame:
    """``memory`` (recipe, failures, demoted) brought up to date with new runs."""
    new = demotions(runs, recipe, failed, most).select(recipe, F.col("failures").alias("more"))
    n = F.coalesce("failures", F.lit(0)) + F.coalesce("more", F.lit(0))
    return memory.join(new, recipe, "full").select(recipe, n.alias("failures"), (n >= most).alias("demoted"))


def ledger(parses: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """path, parses, state: files parsed once, never, or more than once."""
    n = parses.groupBy(path).agg(F.count("*").alias("n"))
    rows = files.select(path).distinct().join(n, path, "full").select(path, F.coalesce("n", F.lit(0)).alias("parses"))
    return rows.select(path, "parses", F.when(F.col("parses") == 1, "once").when(F.col("parses") == 0, "never").otherwise("again").alias("state"))


def commit_digest(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n and digest of all results in the order of their keys, however they were dealt. Rows are digested where they are,
    then by range of the keys' hash, and the ranges in order."""
    row = F.sha2(F.to_json(F.struct(*results.columns)).cast("binary"), 256)
    d = results.select(F.xxhash64(*keys).alias("h"), row.alias("d"))
    part = d.groupBy(F.pmod("h", F.lit(1 << 16)).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "").cast("binary"), 256).alias("d"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("digest"))


def ordered_checks(plan: list[tuple[str, bool]], results: DataFrame) -> DataFrame:
    """order, check, needed, state: the checks of a plan in order with their results (order, check, passed); those after the first needed
    one that failed or has no result are not reached, and the order's verdict is in ``accepted``."""
    steps = results.sparkSession.createDataFrame([(k, c, n) for k, (c, n) in enumerate(plan)], "step int, check string, needed boolean")
    rows = results.select("order").distinct().crossJoin(F.broadcast(steps)).join(results, ["order", "check"], "left")
    bad = F.when(F.col("needed") & ~F.coalesce("passed", F.lit(False)), F.col("step"))
    first = F.min(bad).over(Window.partitionBy("order"))
    state = F.when(F.col("step") > first, "not reached").when(F.col("passed").isNull(), "missing").when(F.col("passed"), "passed").otherwise("failed")
    return rows.select("order", "step", "check", "needed", state.alias("state"), first.isNull().alias("accepted"))


def refreshed(previous: DataFrame, changed: DataFrame, measure, key: str) -> DataFrame:
    """Results brought up to date: ``measure`` runs over the changed rows alone, and others keep their results."""
    return previous.join(changed.select(key).distinct(), key, "left_anti").unionByName(measure(changed))


# -- sources and sinks ---------------------------------------------------------------------------------------------


def coverage_json(reports: DataFrame) -> DataFrame:
    """path, line, hits from the JSON of Python's coverage tool, one report a row (``value``)."""
    kind = "files map<string, struct<executed_lines: array<bigint>, missing_lines: array<bigint>>>"
    files = reports.select(F.explode(F.from_json("value", kind)["files"]).alias("path", "x"))
    lines = files.select("path", F.explode(F.concat(F.transform("x.executed_lines", lambda k: F.struct(k.alias("line"), F.lit(1).alias("hits"))), F.transform("x.missing_lines", lambda k: F.struct(k.alias("line"), F.lit(0).alias("hits"))))).alias("y"))
    return lines.select("path", "y.line", F.col("y.hits").cast("long").alias("hits"))


def julia_coverage(files: DataFrame) -> DataFrame:
    """path, line, hits from the text of Julia's .cov files (path, value): a count or ``-`` before each line."""
    rows = files.select(F.regexp_replace("path", r"(\.\d+)?\.cov$", "").alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "x"))
    hits = F.regexp_extract("x", r"^\s*(\d+)", 1)
    return rows.where(hits != "").groupBy("path", (F.col("at") + 1).cast("long").alias("line")).agg(F.sum(hits.cast("long")).alias("hits"))


def coverage(mode: str, source: DataFrame) -> DataFrame:
    """path, line, hits in any of the modes; ``auto`` looks at the first row."""
    from textloom.sources import artefacts

    if mode == "auto":
        first = source.select("value").first()
        head = (first[0] if first else "").lstrip()
        mode = "coverage-py" if head.startswith("{") else "lcov" if re.match(r"(TN|SF):", head) else "julia-cov"
    readers = {"lcov": lambda s: artefacts.lcov(s), "cloverage": lambda s: artefacts.lcov(s), "coverage-py": coverage_json, "julia-cov": julia_coverage}
    if mode not in readers:
        raise ValueError(f"coverage mode {mode!r} is none of auto, {', '.join(readers)}")
    return readers[mode](source)


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """path, text, revision of all files under ``root/revision=*``: one folder for each revision."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_extract("path", r"/revision=[^/]+/(.*)$", 1)
    return rows.select(inside.alias("path"), F.col("content").cast("string").alias("text"), F.url_decode(F.regexp_extract("path", r"/revision=([^/]+)/", 1)).alias("revision")).where("path <> ''")


HISTORY = "id string, revisions array<struct<ix: int, files: array<struct<path: string, text: string>>, facts: array<struct<path: string, name: string, verdict: string>>>>"


def history(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (id, ix, path, text) and outside facts (id, ix, path, name, verdict) of bundles, one JSON a row (``value``); fails on one that
    is no bundle."""
    parsed = bundles.select(F.from_json("value", HISTORY, {"mode": "FAILFAST"}).alias("b")).select("b.id", F.explode("b.revisions").alias("r"))
    return parsed.select("id", "r.ix", F.explode("r.files").alias("f")).select("id", "ix", "f.*"), parsed.select("id", "r.ix", F.explode("r.facts").alias("f")).select("id", "ix", "f.*")


MANIFEST = "cases array<struct<path: string, lang: string, expectations: array<struct<rule: string, line: int, should_fire: boolean>>>>"


def manifest(reports: DataFrame) -> DataFrame:
    """path, lang, rule, line, should_fire of each expectation in evaluation manifests, one JSON a row (``value``)."""
    cases = reports.select(F.explode(F.from_json("value", MANIFEST, {"mode": "FAILFAST"})["cases"]).alias("c"))
    return cases.select("c.path", "c.lang", F.explode("c.expectations").alias("e")).select("path", "lang", "e.*")


def with_feedback(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Expectations and, for findings that people called false, ones that should not fire; what was said last of a place counts."""
    told = findings.select("path", "lang", "rule", "line").distinct().withColumn("should_fire", F.lit(False))
    return expectations.join(told, ["path", "rule", "line"], "left_anti").select("path", "lang", "rule", "line", "should_fire").unionByName(told)


def put(cache: str, rows: DataFrame, key: str = "key", payload: str = "payload") -> int:
    """Add rows to a content-addressed cache (a Parquet folder) and say how many were new. The same key with another payload is an error,
    and then nothing is written."""
    spark = rows.sparkSession
    new = rows.select(key, payload).distinct()
    clash = new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    try:
        old = spark.read.parquet(cache)
    except Exception as e:  # there is no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        joined = new.join(old.select(key, F.col(payload).alias("had")), key, "left")
        clash = clash.select(key).union(joined.where(F.col("had").isNotNull() & (F.col("had") != F.col(payload))).select(key))
        new = joined.where("had IS NULL").select(key, payload)
    found = clash.select(key).limit(5).collect()
    if found:
        raise ValueError(f"other payloads for {', '.join(str(r[0]) for r in found)}")
    n = new.count()
    if n:
        new.write.mode("append").parquet(cache)
    return n


def capture(snapshot: DataFrame, folder: str, versions: dict[str, str]) -> str:
    """Write a snapshot with the versions that made it; its id is a digest of both."""
    spark = snapshot.sparkSession
    d = commit_digest(snapshot, [snapshot.columns[0]]).first()
    name = spark.range(1).select(F.sha2(F.lit(json.dumps([d.digest, versions], sort_keys=True)).cast("binary"), 256)).first()[0]
    snapshot.write.mode("overwrite").parquet(f"{folder}/{name}/snapshot")
    spark.createDataFrame(sorted(versions.items()), "name string, version string").write.mode("overwrite").parquet(f"{folder}/{name}/versions")
    return name


def restore(spark: SparkSession, folder: str, name: str, versions: dict[str, str]) -> DataFrame:
    """A captured snapshot, if the versions that made it are those asked for."""
    had = {r.name: r.version for r in spark.read.parquet(f"{folder}/{name}/versions").collect()}
    if had != versions:
        raise ValueError(f"captured with {had}, not {versions}")
    return spark.read.parquet(f"{folder}/{name}/snapshot")


def metrics_text(rows: DataFrame, key: str, numbers: list[str]) -> DataFrame:
    """A line of text for each row of metrics: its key, then name=value."""
    return rows.select(key, F.concat_ws(" ", F.col(key).cast("string"), *[F.concat(F.lit(f"{c}="), F.format_string("%.3f", F.col(c).cast("double"))) for c in numbers]).alias("line"))


def metrics_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


