"""Queries of work orders, budgets, configuration wiring and the rule registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import lines as L
from textloom.operators import planning as P
from textloom.operators.rules import RULES
from textloom.plans.line_plans import CODE, code_lines
from textloom.plans.registry import literal_sql, query, table
from textloom.sources import artefacts, corpus

_FIND = [("a", "r1", "magic-number", "risky-suggest", 3), ("a", "r1", "long-method", "llm-only", 1), ("a", "r2", "config-key-unread", "never-auto", 9), ("a", "r2", "magic-number", "risky-suggest", 8), ("b", "r1", "consecutive-blank-lines", "safe-auto", 2), ("b", "r3", "let-and-return", "risky-suggest", 7)]


@query("work_order_drafts", f"WITH f AS {literal_sql(_FIND, 'path, region, rule, safety, line')} SELECT path, region, count(*) AS findings, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules, min(line) AS first_line FROM f WHERE safety IN ('analyzer-confirmed', 'safe-with-precondition', 'risky-suggest', 'llm-only') AND NOT EXISTS (SELECT 1 FROM f n WHERE n.path = f.path AND n.region = f.region AND n.safety = 'never-auto') GROUP BY path, region")
def _(spark, d):
    return P.drafts(spark.createDataFrame(_FIND, "path string, region string, rule string, safety string, line long"))


_ACC = [("w1", "x", "write"), ("w2", "x", "require"), ("w3", "x", "read"), ("w4", "y", "write"), ("w5", "y", "write"), ("w6", "z", "invalidate"), ("w7", "z", "read"), ("w8", "p", "write"), ("w8", "q", "require"), ("w9", "q", "write"), ("w9", "p", "require"), ("w10", "p", "require")]
_ESQL = f"ac AS {literal_sql(_ACC, 'id, resource, mode')}, ed AS (SELECT DISTINCT x.id AS a, y.id AS b, CASE WHEN x.mode = 'write' AND y.mode = 'require' THEN 'prerequisite' WHEN x.mode = 'write' AND y.mode = 'write' AND x.id < y.id THEN 'write-conflict' WHEN x.mode = 'invalidate' AND y.mode IN ('read', 'require') THEN 'invalidates' WHEN x.mode = 'write' AND y.mode = 'read' THEN 'read-conflict' END AS kind FROM ac x JOIN ac y ON x.resource = y.resource AND x.id <> y.id)"


def _access(spark):
    return spark.createDataFrame(_ACC, "id string, resource string, mode string")


@query("work_order_edges", f"WITH {_ESQL} SELECT * FROM ed WHERE kind IS NOT NULL")
def _(spark, d):
    return P.order_edges(_access(spark))


@query("schedule_waves", f"SELECT * FROM {literal_sql([('w1', 0, False), ('w4', 0, False), ('w6', 0, False), ('w2', 1, False), ('w3', 1, False), ('w5', 1, False), ('w7', 1, False), ('w8', -1, True), ('w9', -1, True), ('w10', -1, True)], 'id, wave, blocked')} AS x")
def _(spark, d):
    return P.waves(_access(spark).select("id").distinct(), P.order_edges(_access(spark)))


@query("atomic_groups", f"SELECT * FROM {literal_sql([('a', 'a'), ('b', 'a'), ('c', 'a'), ('d', 'd'), ('e', 'e'), ('f', 'e')], 'id, group_')} AS x")
def _(spark, d):
    return P.atomic_groups(spark.createDataFrame([(x,) for x in "abcdef"], "id string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("f", "e")], "a string, b string"))


@query("work_order_expiry", f"WITH ac AS {literal_sql(_ACC, 'id, resource, mode')} SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM ac WHERE mode IN ('read', 'require') AND resource IN ('x', 'q')) THEN 'expired' ELSE 'retained' END AS state FROM ac")
def _(spark, d):
    return P.replanned(_access(spark).select("id").distinct(), _access(spark), spark.createDataFrame([("x",), ("q",)], "resource string"))


_PATCH = [(k, c, m, v, b) for k, (c, m, v, b) in enumerate((c, m, v, b) for c in (True, False) for m in ("survived", "killed", "none") for v in ("covered", "uncovered", "unknown") for b in (True, False))]


@query("verdicts", f"WITH p AS {literal_sql(_PATCH, 'id, characterized, mutation, coverage, blank')} SELECT id, CASE WHEN characterized THEN 'removable' WHEN mutation = 'survived' THEN CASE WHEN blank THEN 'dead-candidate' ELSE 'untested-risky' END WHEN coverage = 'covered' THEN 'removable' WHEN coverage = 'uncovered' THEN CASE WHEN blank THEN 'dead-candidate' ELSE 'untested-risky' END ELSE 'coverage-unknown' END AS verdict FROM p")
def _(spark, d):
    return P.verdicts(spark.createDataFrame(_PATCH, "id int, characterized boolean, mutation string, coverage string, blank boolean"))


_GUARD = [(1, "x = 1", "x = 1\ny = 2\nz = 3"), (2, "raise E\nx", "x\nyyyyy"), (3, "def a(): pass", "def a(): 1"), (4, "x = 12345678901234567890", "def b(): return 1")]


@query("patch_guards", f"WITH p AS {literal_sql(_GUARD, 'id, before, after')}, k AS (SELECT id, length(after) > 1.5 * length(before) AS g, len(regexp_extract_all(after, '\\b(raise|assert|try|except|throw|catch)\\b')) < len(regexp_extract_all(before, '\\b(raise|assert|try|except|throw|catch)\\b')) AS r, len(regexp_extract_all(after, '(?m)^\\s*(?:pub\\s+fn|export\\s+function|def\\s+[a-z]\\w*)')) > len(regexp_extract_all(before, '(?m)^\\s*(?:pub\\s+fn|export\\s+function|def\\s+[a-z]\\w*)')) AS n FROM p) SELECT id, array_to_string(list_filter([CASE WHEN g THEN 'growth' END, CASE WHEN r THEN 'defensive-code-removed' END, CASE WHEN n THEN 'new-public-definition' END], lambda x: x IS NOT NULL), ',') AS rejected FROM k")
def _(spark, d):
    return P.guards(spark.createDataFrame(_GUARD, "id int, before string, after string"))


@query("mutants", f"WITH {CODE}, t AS (SELECT path, line_no, regexp_extract_all(CASE WHEN instr(line, tk) > 0 THEN substr(line, 1, instr(line, tk) - 1) ELSE line END, '{X.TOKEN}') AS ts FROM (SELECT *, CASE lang WHEN 'clojure' THEN ';' WHEN 'javascript' THEN '//' WHEN 'typescript' THEN '//' WHEN 'rust' THEN '//' ELSE '#' END AS tk FROM l)), u AS (SELECT path, line_no, ts, unnest(range(1, 1 + len(ts))) AS i FROM t) SELECT path, line_no, i AS idx, ts[i] AS token, sw.replacement FROM u JOIN {literal_sql(list(P.SWAPS.items()), 'token, replacement')} AS sw ON sw.token = ts[i]")
def _(spark, d):
    return P.mutants(L.tokens_of(code_lines(spark), "path", lang=F.col("lang")))


@query("mutant_scores", "SELECT event_type AS path, count(*) FILTER (value < 30) AS killed, count(*) FILTER (value >= 30 AND value < 60) AS survived, count(*) FILTER (value >= 60) AS unviable, round(count(*) FILTER (value < 30) / nullif(count(*) FILTER (value < 60), 0), 6) AS score FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    return P.mutant_tally(e.select(F.col("event_type").alias("path"), F.when(F.col("value") < 30, "killed").when(F.col("value") < 60, "survived").otherwise("unviable").alias("outcome")))


@query("budgeted_prefix", "SELECT doc_id, running FROM (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= 100000")
def _(spark, d):
    """A budget is the feature: the prefix of items whose running cost fits."""
    return P.budgeted(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100_000).select("doc_id", "running")


@query("continuation_page", "SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def _(spark, d):
    """Keyset pagination: the page after a cursor."""
    return table(spark, d, "documents").where("doc_id > 100").select("doc_id").orderBy("doc_id").limit(25)


_STAT = [("s1", "complete"), ("s1", "complete"), ("s2", "failed"), ("s2", "unknown"), ("s3", "unknown"), ("s3", "complete"), ("s4", "unsupported"), ("s5", "unsupported"), ("s5", "complete")]


@query("status_rollup", f"WITH s AS {literal_sql(_STAT, 'snap, status')} SELECT snap, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'unknown') THEN 'unknown' WHEN bool_and(status = 'unsupported') THEN 'unsupported' ELSE 'partial' END AS status FROM s GROUP BY snap")
def _(spark, d):
    return P.statuses(spark.createDataFrame(_STAT, "snap string, status string"), "snap")


_REQ = [("o1", "tests"), ("o1", "types"), ("o2", "tests")]
_EV = [("o1", "tests", True), ("o1", "types", True), ("o1", "types", False), ("o2", "types", True)]


@query("evidence_evaluation", f"WITH r AS {literal_sql(_REQ, 'id, kind')}, g AS (SELECT id, kind, bool_or(passed) AS ok, count(*) FILTER (NOT passed) AS against FROM {literal_sql(_EV, 'id, kind, passed')} AS e GROUP BY ALL) SELECT id, bool_and(coalesce(ok, false)) AS satisfied, CAST(sum(coalesce(against, 0)) AS BIGINT) AS counter FROM r LEFT JOIN g USING (id, kind) GROUP BY id")
def _(spark, d):
    return P.evidence(spark.createDataFrame(_REQ, "id string, kind string"), spark.createDataFrame(_EV, "id string, kind string, passed boolean"))


@query("rule_registry", f"SELECT safety, count(*) AS n, min(rule) AS first FROM {literal_sql(RULES, 'rule, safety, severity')} AS r GROUP BY safety")
def _(spark, d):
    return spark.createDataFrame(RULES, "rule string, safety string, severity string").groupBy("safety").agg(F.count("*").alias("n"), F.min("rule").alias("first"))


@query("severity_threshold", f"SELECT rule FROM {literal_sql(RULES, 'rule, safety, severity')} AS r WHERE CASE severity WHEN 'info' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END >= 1")
def _(spark, d):
    order = F.when(F.col("severity") == "info", 0).when(F.col("severity") == "minor", 1).otherwise(2)
    return spark.createDataFrame(RULES, "rule string, safety string, severity string").where(order >= 1).select("rule")


_CF = literal_sql(corpus.CONFIG, "path, text")
_KEYS = f"cl AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line_no FROM {_CF} AS c), ky AS (SELECT path, line_no, CASE WHEN path LIKE '%.toml' THEN regexp_extract(line, '^\\s*([A-Za-z0-9_-]+)\\s*=', 1) WHEN path LIKE '%.yaml' THEN regexp_extract(line, '^\\s*(?:-\\s+)?([A-Za-z0-9_.-]+)\\s*:', 1) ELSE regexp_extract(line, '\"([A-Za-z0-9_.-]+)\"\\s*:', 1) END AS key FROM cl)"


@query("config_keys", f"WITH {_KEYS} SELECT path, line_no, key, lower(replace(replace(replace(replace(key, '-', ''), '_', ''), '.', ''), ':', '')) AS nkey FROM ky WHERE key <> ''")
def _(spark, d):
    return artefacts.config_keys(spark.createDataFrame(corpus.CONFIG, "path string, text string"))


_N = "lower(replace(replace(replace(replace(key, '-', ''), '_', ''), '.', ''), ':', ''))"


@query("config_boundary", f"""WITH {_KEYS}, dc AS (SELECT {_N} AS nkey, count(*) AS declared FROM ky WHERE key <> '' AND path NOT IN ('package.json') GROUP BY 1), us AS (SELECT {_N} AS nkey, count(*) FILTER (kind = 'parsed') AS parsed, count(*) FILTER (kind = 'echoed') AS echoed, count(*) FILTER (kind = 'stored') AS stored, count(*) FILTER (kind = 'live') AS live, count(*) FILTER (kind = 'shadowed') AS shadowed FROM {literal_sql(corpus.USES, 'path, line, key, kind')} AS u GROUP BY 1),
j AS (SELECT nkey, coalesce(declared, 0) AS declared, coalesce(parsed, 0) AS parsed, coalesce(live, 0) AS live, coalesce(shadowed, 0) AS shadowed, coalesce(parsed + echoed + stored + live + shadowed, 0) AS uses FROM dc FULL JOIN us USING (nkey) WHERE length(nkey) >= 4)
SELECT nkey, declared, uses, CASE WHEN declared > 0 AND uses = 0 THEN 'config-key-unread' WHEN shadowed > 0 THEN 'config-key-shadowed' WHEN parsed > 0 AND live = 0 THEN 'config-key-unconsumed' END AS rule FROM j""")
def _(spark, d):
    """Declared keys against the evidence that code leaves of reading them, by normalised key."""
    keys = artefacts.config_keys(spark.createDataFrame(corpus.CONFIG, "path string, text string"))
    uses = spark.createDataFrame(corpus.USES, "path string, line long, key string, kind string")
    return artefacts.config_boundary(keys.where(~F.element_at(F.split("path", "/"), -1).isin(*artefacts.TOOL_CONFIGS)), uses)


_LABELS = [("self.total",), ("this.x.y",), ("a::b.c/d",), ("np.Float32",), ("plain",)]


@query("identifier_functions", f"SELECT label, regexp_replace(label, '^(self\\.|this\\.)', '') AS reference, string_split(label, '.')[-1] AS leaf, string_split(label, '.')[1] AS root, regexp_matches(string_split(label, '.')[-1], '^[A-Z]') AS type_like, array_to_string(regexp_split_to_array(label, '::|\\.|/'), '>') AS segments FROM {literal_sql(_LABELS, 'label')} AS x".replace("VALUES ", "VALUES "))
def _(spark, d):
    c = F.col("label")
    return spark.createDataFrame(_LABELS, "label string").select("label", X.normalized_reference(c).alias("reference"), X.token_leaf(c).alias("leaf"), X.token_root(c).alias("root"), X.type_like(c).alias("type_like"), F.array_join(X.qualified_segments(c), ">").alias("segments"))


@query("key_predicates", f"SELECT DISTINCT token, regexp_matches(token, '^[A-Z0-9_]{{4,}}$') AND regexp_matches(token, '[A-Z]') AS env, length(token) <= 64 AND regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '^[A-Za-z0-9_.:-]+$') AND NOT contains(token, '::') AND NOT regexp_matches(token, '^\\.|\\.$') AS key_like FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_.:-]+')) AS token FROM documents)")
def _(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_.:-]+)"), F.lit(1))).alias("token")).distinct()
    return t.select("token", X.env_shaped(F.col("token")).alias("env"), X.key_shaped(F.col("token")).alias("key_like"))
