"""Queries of records: paths, evidence, gates, scores of families, memories, deltas and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import records
from textloom.plans.registry import literal_sql, query, table
from textloom.sources import corpus

_PATHS = [("a/b.py",), ("a/b.pyi",), ("x.JSX",), ("x.tsx",), ("x.ts",), ("m.mjs",), ("s.rs",), ("c.cljc",), ("j.jl",), ("t.txt",), ("noending",)]


@query("grammar_selection", f"WITH p AS {literal_sql(_PATHS, 'path')}, g AS {literal_sql(list(records.GRAMMARS.items()), 'ending, grammar')} SELECT path, arg_max(grammar, length(ending)) AS grammar FROM p LEFT JOIN g ON lower(path) LIKE '%' || ending GROUP BY path")
def _(spark, d):
    return spark.createDataFrame(_PATHS, "path string").select("path", records.grammar(F.col("path")).alias("grammar"))


@query("display_paths", "SELECT doc_id AS path, coalesce(url, CAST(doc_id AS VARCHAR)) AS display, n_chars FROM documents LEFT JOIN pages ON page_id = doc_id")
def _(spark, d):
    shown = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("url").alias("display"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "n_chars")
    return records.display_paths(rows, shown).withColumn("path", F.col("path").cast("long"))


@query("bounded_identifiers", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z_]+')))[:96], ',') AS names FROM documents")
def _(spark, d):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.array_join(records.bounded_identifiers(words), ",").alias("names"))


@query("maximal_texts", "WITH x AS (SELECT conv_id, list(DISTINCT text) AS ts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, len(list_filter(ts, lambda a: len(list_filter(ts, lambda b: length(b) > length(a) AND contains(b, a))) = 0)) AS maximal FROM x")
def _(spark, d):
    """Of each conversation's texts, how many no longer one contains."""
    g = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.collect_set("text").alias("ts"))
    return g.select("conv_id", F.size(records.maximal_texts(F.col("ts"))).cast("long").alias("maximal"))


@query("utf16_positions", """WITH h AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS head FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, head, string_split(head, chr(10)) AS parts FROM h)
SELECT doc_id, len(parts) - 1 AS line, length(parts[-1]) + len(regexp_extract_all(parts[-1], '[\\x{10000}-\\x{10FFFF}]')) AS col FROM l""")
def _(spark, d):
    """The line and UTF-16 column of each text's middle, from its byte offset."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    at = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    line, column = records.utf16_column(F.col("text"), at)
    return docs.select("doc_id", line.cast("long").alias("line"), column.cast("long").alias("col"))


@query("five_line_windows", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, array_to_string(ls[k:k + 4], ' ') AS w FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM l))
SELECT doc_id, count(*) AS windows, count(*) FILTER (contains(w, '0') AND contains(w, 'a')) AS met FROM w GROUP BY doc_id""")
def _(spark, d):
    w = records.line_windows(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("long").alias("windows"), F.size(F.filter(w, lambda x: F.contains(x, F.lit("0")) & F.contains(x, F.lit("a")))).cast("long").alias("met"))


@query("inputs_by_role", "SELECT role, count(*) AS n FROM (SELECT 'source' AS role FROM documents UNION ALL SELECT 'auxiliary' FROM benchmark) GROUP BY role")
def _(spark, d):
    one = table(spark, d, "documents").select(F.lit("source").alias("role"), "text").unionByName(table(spark, d, "benchmark").select(F.lit("auxiliary").alias("role"), "text"))
    return one.groupBy("role").agg(F.count("*").alias("n"))


@query("provider_evidence", "WITH f AS (SELECT doc_id, label, count(*) FILTER (ok) AS supporting, count(*) FILTER (NOT ok) AS conflicting FROM (SELECT doc_id, 'quality' AS label, quality = 1 AS ok FROM labels UNION ALL SELECT doc_id, 'quality', toxic = 0 FROM labels) GROUP BY ALL) SELECT d.doc_id, 'quality' AS label, coalesce(supporting, 0) AS supporting, coalesce(conflicting, 0) AS conflicting FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id")
def _(spark, d):
    told = table(spark, d, "labels")
    facts = told.select("doc_id", F.lit("quality").alias("label"), (F.col("quality") == 1).alias("ok")).unionByName(told.select("doc_id", F.lit("quality").alias("label"), (F.col("toxic") == 0).alias("ok")))
    rows = table(spark, d, "documents").select("doc_id", F.lit("quality").alias("label"))
    return records.evidence(rows, facts, ["doc_id", "label"], "ok")


_FIRED = "f AS (SELECT source, lang, doc_id, length(text) > 900 AS fired, quality = 1 AS wanted FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)"
_SCORES = "SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall"


def _wilson_sql(a: str, b: str) -> str:
    n, p, z = f"({a} + {b})", f"({a} / ({a} + {b}))", 1.959963984540054
    return f"round(CASE WHEN {n} > 0 THEN greatest(0, ({p} + {z * z} / (2 * {n}) - {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})) END, 6)"


_CONFUSION = f"{_SCORES}, {_wilson_sql('tp', 'fp')} AS precision_low, {_wilson_sql('tp', 'fn')} AS recall_low"


def _fired(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL").join(table(spark, d, "labels"), "doc_id")
    return rows.select("source", "lang", "doc_id", (F.length("text") > 900).alias("fired"), (F.col("quality") == 1).alias("wanted"))


@query("family_scores", f"WITH {_FIRED}, c AS (SELECT source, count(*) FILTER (fired AND wanted) AS tp, count(*) FILTER (fired AND NOT wanted) AS fp, count(*) FILTER (NOT fired AND NOT wanted) AS tn, count(*) FILTER (NOT fired AND wanted) AS fn FROM f GROUP BY source) {_CONFUSION} FROM c")
def _(spark, d):
    return records.confusion(_fired(spark, d), ["source"], "fired", "wanted")


@query("recipe_evaluation", f"""WITH {_FIRED}, k AS (SELECT lang, source, bool_or(wanted) AS w, bool_and(fired = wanted) AS ok FROM f GROUP BY ALL), p AS (SELECT lang, w, CASE WHEN ok THEN w ELSE NOT w END AS fired FROM k),
c AS (SELECT lang, count(*) FILTER (fired AND w) AS tp, count(*) FILTER (fired AND NOT w) AS fp, count(*) FILTER (NOT fired AND NOT w) AS tn, count(*) FILTER (NOT fired AND w) AS fn FROM p GROUP BY lang) {_CONFUSION} FROM c""")
def _(spark, d):
    """Sources as clusters of variants, within languages."""
    return records.clustered(_fired(spark, d), ["lang"], "source", "fired", "wanted")


@query("promotion_gate", f"WITH {_FIRED}, c AS (SELECT source, count(*) FILTER (fired AND wanted) AS tp, count(*) FILTER (fired AND NOT wanted) AS fp FROM f GROUP BY source), l AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), y AS (SELECT l.source, CASE WHEN tp IS NULL THEN 'not scored' WHEN tp + fp = 0 THEN 'never fired' WHEN round(tp / (tp + fp), 6) < 0.6 THEN 'precision too low' ELSE '' END AS why FROM l LEFT JOIN c ON c.source = l.source) SELECT source, why = '' AS promoted, why FROM y")
def _(spark, d):
    least = table(spark, d, "documents").select("source").where("source IS NOT NULL").distinct().withColumn("least", F.lit(0.6))
    return records.promoted(records.confusion(_fired(spark, d), ["source"], "fired", "wanted"), least, "source")


@query("snapshot_cases", """WITH f AS (SELECT DISTINCT conv_id % 97 AS c, role AS r FROM conversations), w AS (SELECT DISTINCT conv_id % 89 AS c, role AS r FROM conversations WHERE turn < 2), j AS (SELECT coalesce(f.c, w.c) AS conv, count(*) FILTER (f.c IS NULL) AS missing, count(*) FILTER (w.c IS NULL) AS extra FROM f FULL JOIN w ON f.c = w.c AND f.r = w.r GROUP BY ALL) SELECT conv, missing, extra, missing = 0 AND extra = 0 AS equal FROM j""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return records.cases_equal(c.select((F.col("conv_id") % 97).alias("conv"), "role"), c.where("turn < 2").select((F.col("conv_id") % 89).alias("conv"), "role"), "conv", "role")


_NEEDS = [("extract", "syntax"), ("extract", "flow"), ("inline", "scopes"), ("inline", "calls"), ("order", "syntax"), ("move", "imports")]
_LAYERS = [("syntax", "complete"), ("flow", "complete"), ("scopes", "complete"), ("calls", "partial")]


@query("eligibility_gates", f"WITH n AS {literal_sql(_NEEDS, 'recipe, layer')}, l AS {literal_sql(_LAYERS, 'layer, status')}, b AS (SELECT recipe, CASE WHEN status IS NULL THEN layer || ': missing' WHEN status <> 'complete' THEN layer || ': ' || status END AS block FROM n LEFT JOIN l USING (layer)) SELECT recipe, count(block) = 0 AS eligible, coalesce(string_agg(block, ', ' ORDER BY block), '') AS blocks FROM b GROUP BY recipe")
def _(spark, d):
    return records.eligibility(spark.createDataFrame(_NEEDS, "recipe string, layer string"), spark.createDataFrame(_LAYERS, "layer string, status string"))


@query("demotion_memory", "SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AS demoted FROM events GROUP BY user_id")
def _(spark, d):
    """Users as recipes, in two halves: what was remembered of the first is brought up to date with the second."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    first = records.demotions(e.where("event_id % 2 = 0"), "user_id", "failed")
    return records.remembered(first, e.where("event_id % 2 <> 0"), "user_id", "failed")


@query("parse_ledger", "WITH p AS (SELECT o_custkey AS path, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(path, c_custkey) AS path, coalesce(n, 0) AS parses, CASE WHEN n IS NULL THEN 'never' WHEN n = 1 THEN 'once' ELSE 'again' END AS state FROM customer FULL JOIN p ON path = c_custkey")
def _(spark, d):
    return records.ledger(table(spark, d, "orders").select(F.col("o_custkey").alias("path")), table(spark, d, "customer").select(F.col("c_custkey").alias("path")))


@query("graph_delta", """WITH s AS (SELECT event_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), x AS (SELECT DISTINCT a, b FROM s WHERE b IS NOT NULL AND event_id % 2 = 0 AND a <> 'view'), y AS (SELECT DISTINCT a, b FROM s WHERE b IS NOT NULL AND event_id % 2 = 1 AND b <> 'view')
SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, CASE WHEN x.a IS NULL THEN 'added' WHEN y.a IS NULL THEN 'removed' ELSE 'kept' END AS change FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b""")
def _(spark, d):
    """What differs between the steps that leave views out at their start, and those that do at their end, in the two halves."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    s = e.select("event_id", F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b IS NOT NULL")
    return records.graph_delta(s.where("event_id % 2 = 0 AND a <> 'view'"), s.where("event_id % 2 = 1 AND b <> 'view'"))


_PLAN = [("parses", True), ("style", False), ("tests", True), ("coverage", True)]
_DONE = [("o1", "parses", True), ("o1", "style", False), ("o1", "tests", True), ("o1", "coverage", True), ("o2", "parses", True), ("o2", "tests", False), ("o2", "coverage", True), ("o3", "style", True)]


@query("authority_plan", f"""WITH p AS {literal_sql([(k, c, n) for k, (c, n) in enumerate(_PLAN)], 'step, chk, needed')}, r AS {literal_sql(_DONE, 'ord, chk, passed')}, j AS (SELECT o.ord, p.*, passed FROM (SELECT DISTINCT ord FROM r) o, p LEFT JOIN r ON r.ord = o.ord AND r.chk = p.chk), f AS (SELECT *, min(CASE WHEN needed AND NOT coalesce(passed, false) THEN step END) OVER (PARTITION BY ord) AS bad FROM j)
SELECT ord AS "order", step, chk AS "check", needed, CASE WHEN step > bad THEN 'not reached' WHEN passed IS NULL THEN 'missing' WHEN passed THEN 'passed' ELSE 'failed' END AS state, bad IS NULL AS accepted FROM f""")
def _(spark, d):
    return records.ordered_checks(_PLAN, spark.createDataFrame(_DONE, "order string, check string, passed boolean"))


@query("workspace_refresh", "SELECT doc_id, len(string_split(text, chr(10))) AS nloc, length(text) AS size FROM documents")
def _(spark, d):
    """Results of all documents, of which those with labels were measured anew; SQL measures them all."""
    measure = lambda docs: docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("nloc"), F.length("text").cast("long").alias("size"))
    docs = table(spark, d, "documents")
    stale = measure(docs).withColumn("size", F.when(F.col("doc_id") % 2 == 0, F.col("size")).otherwise(-1))
    return records.refreshed(stale, docs.where("doc_id % 2 <> 0"), measure, "doc_id")


@query("metrics_lines", "SELECT source, CAST(source AS VARCHAR) || ' regions=' || printf('%.3f', count(*)::DOUBLE) || ' tokens=' || printf('%.3f', sum(n_chars)::DOUBLE) AS line FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("regions"), F.sum("n_chars").alias("tokens"))
    return records.metrics_text(rows, "source", ["regions", "tokens"])


@query("metrics_json", """SELECT lang, '{"lang":"' || lang || '","regions":' || count(*) || ',"tokens":' || CAST(sum(n_chars) AS BIGINT) || '}' AS json FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def _(spark, d):
    return records.metrics_json(table(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("regions"), F.sum("n_chars").alias("tokens")), "lang")


@query("deterministic_commit")
def _(spark, d):
    return records.commit_digest(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"])


@query("guard_facts")
def _(spark, d):
    """Guards in the code corpus, and in prose, which has none but by chance."""
    files = corpus.modules(spark).select("path", "text").unionByName(table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text"))
    out = records.guard_facts(files, "path")
    return out.select("path", "fail_loud", *[F.array_join(c, ",").alias(c) for c in ("identifiers", "predicate_identifiers", "features")])


@query("masked_sources")
def _(spark, d):
    return corpus.modules(spark).select("path", records.executable_text("text").alias("code"))
