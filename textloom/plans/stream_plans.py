"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import lines as L
from textloom.operators import reports as R
from textloom.operators import rules
from textloom.plans.graph_plans import EDGES
from textloom.plans.line_plans import CODE, code_lines
from textloom.plans.registry import literal_sql, query, table
from textloom.sources import artefacts, corpus
from textloom.streaming import edits as S

_IDIOM = f"WITH {CODE}, r AS {literal_sql(L.IDIOMS, 'rule, lang, pattern')}, fd AS (SELECT DISTINCT path, line_no AS line, rule FROM l JOIN r USING (lang) WHERE regexp_matches(line, pattern))"


def _findings(spark):
    return L.idiom_findings(code_lines(spark)).withColumnRenamed("line_no", "line")


@query("text_report", f"{_IDIOM} SELECT path, string_agg(path || ':' || line || ' ' || rule, chr(10) ORDER BY line, rule) AS report FROM fd GROUP BY path")
def _(spark, d):
    return R.text_report(_findings(spark))


@query("json_report", f"""{_IDIOM} SELECT path, '{{"path":"' || path || '","findings":[' || string_agg('{{"line":' || line || ',"rule":"' || rule || '"}}', ',' ORDER BY line, rule) || ']}}' AS json FROM fd GROUP BY path""")
def _(spark, d):
    return R.json_report(_findings(spark))


def _full(spark):
    reg = spark.createDataFrame(rules.RULES, "rule string, safety string, severity string")
    return _findings(spark).join(F.broadcast(reg), "rule").withColumn("message", F.col("rule"))


@query("sarif_results", f"""{_IDIOM}, g AS {literal_sql(rules.RULES, 'rule, safety, severity')} SELECT path, line, rule, '{{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'major' THEN 'error' WHEN 'minor' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || rule || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' AS result FROM fd JOIN g USING (rule)""")
def _(spark, d):
    return R.sarif_results(_full(spark))


@query("sarif_log")
def _(spark, d):
    return R.sarif(_full(spark))


@query("graph_dot", f"WITH e AS {literal_sql(EDGES, 'a, b, api, flow')} SELECT 'digraph {{' || chr(10) || string_agg('  \"' || a || '\" -> \"' || b || '\";', chr(10) ORDER BY '  \"' || a || '\" -> \"' || b || '\";') || chr(10) || '}}' AS dot FROM (SELECT DISTINCT a, b FROM e)")
def _(spark, d):
    return R.dot(spark.createDataFrame(EDGES, "a string, b string, api int, flow int"))


@query("splices", "SELECT doc_id, sha256('[' || substr(text, 3)) AS digest, length(text) - 1 AS n FROM documents")
def _(spark, d):
    """The first two characters of each text replaced by a bracket."""
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(2).cast("long").alias("end"), F.lit("[").alias("replacement")))
    out = table(spark, d, "documents").select("doc_id", R.edited(F.col("text"), one).alias("t"))
    return out.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.length("t").alias("n"))


@query("automatic_fixes", f"WITH {CODE} SELECT path, line_no, regexp_replace(regexp_replace(line, '\\(not\\s+\\(=\\s+([^()\\n]+?)\\)\\)', '(not= \\1)'), '\\(not\\s+\\(nil\\?\\s+([^()\\n]+?)\\)\\)', '(some? \\1)') AS fixed FROM l WHERE lang = 'clojure' AND regexp_matches(line, '\\(not\\s+\\((=|nil\\?)\\s')")
def _(spark, d):
    fixed = F.regexp_replace(F.regexp_replace("line", r"\(not\s+\(=\s+([^()\n]+?)\)\)", r"(not= $1)"), r"\(not\s+\(nil\?\s+([^()\n]+?)\)\)", r"(some\? $1)")
    return code_lines(spark).where((F.col("lang") == "clojure") & F.col("line").rlike(r"\(not\s+\((=|nil\?)\s")).select("path", "line_no", fixed.alias("fixed"))


_DIFF = [("a", "one\ntwo\n", "one\n2\n"), ("b", "same\n", "same\n")]


@query("unified_diff")
def _(spark, d):
    return spark.createDataFrame(_DIFF, "path string, before string, after string").select("path", R.unified_diff("path", "before", "after").alias("diff"), R.derived_edit("before", "after").alias("edit"))


@query("baseline_fingerprints")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", R.fnv1a(F.concat_ws("ÿ", F.col("doc_id").cast("string"), "text")).alias("fingerprint"))


@query("snapshot_identity", "SELECT CAST(sum(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || sha256(text)), 1, 15) AS HUGEINT)) AS VARCHAR) AS snapshot, count(*) AS files FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return artefacts.snapshot_id(docs, "doc_id", "h")


@query("language_detection", f"SELECT path, CASE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'clj' THEN 'clojure' WHEN 'jl' THEN 'julia' ELSE 'generic' END AS lang FROM {literal_sql(corpus.FILES, 'path, lang0, text')} AS f")
def _(spark, d):
    return corpus.files(spark).select("path", artefacts.language(F.col("path")).alias("lang"))


@query("overlay", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'draft' ELSE lang END AS lang FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return artefacts.overlaid(docs, table(spark, d, "labels").select("doc_id", F.lit("draft").alias("lang")), "doc_id")


_LCOV = [("r", 0, "TN:"), ("r", 1, "SF:a.py"), ("r", 2, "DA:1,4"), ("r", 3, "DA:2,0"), ("r", 4, "end_of_record"), ("r", 5, "SF:b.py"), ("r", 6, "DA:1,1"), ("r", 7, "DA:1,2")]


@query("lcov", f"WITH x AS {literal_sql(_LCOV, 'report, pos, value')}, f AS (SELECT *, last_value(CASE WHEN value LIKE 'SF:%' THEN substr(value, 4) END IGNORE NULLS) OVER (PARTITION BY report ORDER BY pos) AS path FROM x) SELECT path, CAST(string_split(substr(value, 4), ',')[1] AS BIGINT) AS line, CAST(sum(CAST(string_split(substr(value, 4), ',')[2] AS BIGINT)) AS BIGINT) AS hits FROM f WHERE value LIKE 'DA:%' GROUP BY ALL")
def _(spark, d):
    return artefacts.lcov(spark.createDataFrame(_LCOV, "report string, pos long, value string"))


@query("coverage_of_regions", f"SELECT * FROM {literal_sql([('a.py', 'f', 'covered'), ('a.py', 'g', 'uncovered'), ('a.py', 'h', 'partial'), ('c.py', 'f', 'unknown')], 'path, region, status')} AS x")
def _(spark, d):
    regions = spark.createDataFrame([("a.py", "f", 1, 1), ("a.py", "g", 2, 2), ("a.py", "h", 1, 9), ("c.py", "f", 1, 9)], "path string, region string, start_line long, end_line long")
    return artefacts.coverage_of(regions, artefacts.lcov(spark.createDataFrame(_LCOV, "report string, pos long, value string")))


_NUM = [("3\t4\ta.py",), ("-\t-\tlogo.png",), ("0\t9\tsome dir/b.py",)]


@query("numstat", f"SELECT string_split(value, chr(9))[3] AS path, coalesce(try_cast(string_split(value, chr(9))[1] AS BIGINT), 0) AS added, coalesce(try_cast(string_split(value, chr(9))[2] AS BIGINT), 0) AS deleted, value LIKE '-%' AS binary FROM {literal_sql(_NUM, 'value')} AS x")
def _(spark, d):
    return artefacts.numstat(spark.createDataFrame(_NUM, "value string"))


_LINT = [("clippy", '{"file":"a.rs","line":3,"code":"clippy::needless_return","message":"m"}'), ("jet", '{"file":"a.jl","line":9,"code":"E1","message":"bad"}'), ("clj-kondo", '{"file":"a.clj","line":1,"code":"other","message":"x"}'), ("staticlint", '{"file":"b.jl","line":2,"code":"UnusedBinding","message":"u"}')]


@query("linter_findings", f"WITH x AS {literal_sql(_LINT, 'tool, json')}, j AS (SELECT tool, json_extract_string(json, '$.file') AS path, CAST(json_extract_string(json, '$.line') AS BIGINT) AS line, json_extract_string(json, '$.code') AS code, json_extract_string(json, '$.message') AS message FROM x) SELECT path, line, rule, message FROM j JOIN {literal_sql(artefacts.LINTER_RULES, 'tool, code, rule')} AS r ON r.tool = j.tool AND r.code IN (j.code, '*')")
def _(spark, d):
    return artefacts.linter_findings(spark.createDataFrame(_LINT, "tool string, json string"))


@query("rule_suppression", f"{_IDIOM} SELECT path, line, rule FROM fd WHERE rule <> 'py-range-len' AND NOT regexp_matches(path, '^web/.*$') AND NOT (rule = 'reimpl-vec' AND path LIKE 'core/%')")
def _(spark, d):
    return rules.suppressed(_findings(spark), ["py-range-len"], ["web/**"], {"reimpl-vec": ["core/*.clj"]})


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("latest_version", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return S.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """An extension: event-time windows."""
    return S.windowed(table(spark, d, "events"))


@query("streamed_windows")
def _(spark, d):
    """The same as a stream with a watermark, run over what is there; windows still open are not given out."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return S.collected(S.windowed(S.event_stream(spark, d, schema, "events.parquet")))


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return S.sessions(table(spark, d, "events"))


@query("invalidation", f"WITH RECURSIVE e AS {literal_sql(EDGES, 'a, b, api, flow')}, r AS (SELECT 'format' AS path UNION SELECT e.a FROM r JOIN e ON e.b = r.path) SELECT path FROM r")
def _(spark, d):
    e = spark.createDataFrame(EDGES, "a string, b string, api int, flow int")
    return S.invalidated(spark.createDataFrame([("format",)], "path string"), e, e.select(F.col("a").alias("path")), True)


@query("cache_misses", "SELECT sha256(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    seen = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return artefacts.cache_misses(docs.select("content_hash"), seen)
