"""Queries over lines and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import duplicates as D
from textloom.operators import lines as L
from textloom.plans.registry import literal_sql, query, table
from textloom.sources import corpus

FILES = literal_sql(corpus.FILES, "path, lang, text")
#: Lines of the code corpus, for the other queries' SQL.
CODE = f"f AS {FILES}, l AS (SELECT path, lang, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))) AS line_no FROM f)"
TOKEN_SQL = "CASE lang WHEN 'clojure' THEN ';' WHEN 'javascript' THEN '//' WHEN 'typescript' THEN '//' WHEN 'rust' THEN '//' ELSE '#' END"
MARKED = f"{CODE}, m AS (SELECT *, {TOKEN_SQL} AS tok FROM l), c AS (SELECT *, instr(line, tok) AS pos FROM m), k AS (SELECT path, lang, line_no, line, CASE WHEN pos > 0 THEN substr(line, 1, pos - 1) ELSE line END AS code, CASE WHEN pos > 0 THEN trim(substr(line, pos + length(tok))) END AS comment FROM c)"


def code_lines(spark):
    return L.plain_lines(corpus.files(spark), "path", "lang")


DOC_LINES = "l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))) AS line_no FROM documents)"


@query("lines", f"WITH {DOC_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM l")
def _(spark, d):
    return L.lines_of(table(spark, d, "documents"), "doc_id")


@query("metric_tokens", f"WITH {MARKED}, t AS (SELECT path, line_no, list_concat(list_transform(regexp_extract_all(code, '{X.TOKEN}'), lambda x: struct_pack(token := x, is_comment := false)), list_transform(regexp_extract_all(CASE WHEN comment IS NULL THEN '' ELSE substr(line, length(code) + 1) END, '{X.TOKEN}'), lambda x: struct_pack(token := x, is_comment := true))) AS ts FROM k) SELECT path, line_no, CAST(i AS BIGINT) AS idx, ts[i].token AS token, ts[i].is_comment AS is_comment FROM (SELECT *, unnest(range(1, 1 + len(ts))) AS i FROM t)")
def _(spark, d):
    return L.tokens_of(code_lines(spark), "path", lang=F.col("lang"))


@query("idiom_findings", f"WITH {CODE}, r AS {literal_sql(L.IDIOMS, 'rule, lang, pattern')} SELECT DISTINCT path, line_no, rule FROM l JOIN r USING (lang) WHERE regexp_matches(line, pattern)")
def _(spark, d):
    return L.idiom_findings(code_lines(spark))


@query("idiom_counts_by_language", f"WITH {CODE}, r AS {literal_sql(L.IDIOMS, 'rule, lang, pattern')} SELECT lang, rule, count(*) AS n FROM (SELECT DISTINCT lang, path, line_no, rule FROM l JOIN r USING (lang) WHERE regexp_matches(line, pattern)) GROUP BY lang, rule")
def _(spark, d):
    lang = corpus.files(spark).select("path", "lang")
    return L.idiom_findings(code_lines(spark)).join(F.broadcast(lang), "path").groupBy("lang", "rule").agg(F.count("*").alias("n"))


@query("consecutive_blank_lines", f"WITH {CODE}, b AS (SELECT path, lang, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM l WHERE trim(line) = ''), r AS (SELECT path, lang, min(line_no) AS a, max(line_no) AS z, CASE lang WHEN 'python' THEN 2 ELSE 1 END AS most FROM b GROUP BY path, lang, g) SELECT path, a + most AS start_line, z AS end_line FROM r WHERE z - a + 1 > most")
def _(spark, d):
    return L.blank_runs(code_lines(spark))


_FULL = f"{MARKED}, full_ AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM k WHERE comment IS NOT NULL AND trim(code) = ''), runs AS (SELECT path, min(line_no) AS a, max(line_no) AS z FROM full_ GROUP BY path, g)"


@query("comment_blocks", f"WITH {_FULL}, first_code AS (SELECT path, min(line_no) AS code FROM k WHERE NOT (comment IS NOT NULL AND trim(code) = '') AND trim(line) <> '' GROUP BY path) SELECT path, a AS start_line, z AS end_line FROM runs JOIN first_code USING (path) WHERE z - a >= 3 AND a > code")
def _(spark, d):
    return L.comment_blocks(code_lines(spark))


@query("narrating_comments", f"WITH {_FULL} SELECT path, line_no, comment FROM k WHERE comment <> '' AND len(regexp_extract_all(comment, '\\S+')) <= 9 AND NOT regexp_matches(comment, '^[\\s\\-=*#/~_]{{6,}}$') AND regexp_matches(comment, '{X.NARRATION.replace(chr(39), chr(39) * 2)}') AND NOT EXISTS (SELECT 1 FROM runs WHERE runs.path = k.path AND z > a AND line_no BETWEEN a AND z)")
def _(spark, d):
    return L.narrating_comments(code_lines(spark))


_MAGIC = f"{MARKED}, q AS (SELECT path, line_no, regexp_replace(regexp_replace(code, '\"[^\"]*\"', '\"\"', 'g'), '''[^'']*''', '''''', 'g') AS code FROM k), n AS (SELECT path, line_no, list_filter(regexp_extract_all(code, '[A-Za-z0-9_]*-?[0-9][0-9.]*[A-Za-z_]?'), lambda x: regexp_full_match(x, '-?[0-9][0-9.]*') AND x NOT IN ('-1', '0', '1', '2', '0.0', '1.0', '2.0')) AS found FROM q WHERE trim(code) <> '' AND NOT regexp_matches(trim(code), '^(const |static |\\(def |:|struct |enum )') AND NOT contains(code, '#[') AND NOT contains(code, '::'))"


@query("magic_numbers", f"WITH {_MAGIC} SELECT path, min(line_no) AS line_no, arg_min(found[1], line_no) AS number FROM n WHERE len(found) > 0 GROUP BY path")
def _(spark, d):
    return L.first_magic_numbers(code_lines(spark))


_STUB = X.STUB.replace("'", "''")


@query("incompleteness", f"WITH {CODE} SELECT path, line_no FROM l WHERE regexp_matches(line, '{_STUB}')")
def _(spark, d):
    return L.incompleteness(code_lines(spark))


@query("let_and_return", f"WITH {CODE}, w AS (SELECT path, line_no, regexp_extract(line, '^\\s*let\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*=', 1) AS name, regexp_replace(trim(lead(line) OVER (PARTITION BY path ORDER BY line_no)), ';$', '') AS after FROM l WHERE lang = 'rust') SELECT path, line_no, name FROM w WHERE name <> '' AND name = after")
def _(spark, d):
    return L.let_and_return(code_lines(spark))


@query("nloc", f"WITH {MARKED} SELECT path, count(*) FILTER (trim(code) <> '') AS nloc, count(*) FILTER (trim(line) <> '') AS nonblank FROM k GROUP BY path")
def _(spark, d):
    return L.nloc(code_lines(spark), "path", lang=F.col("lang"))


WEIGHTS = literal_sql(L.SLOP_WEIGHTS, "rule, weight")
#: 24-word windows shared by documents, computed once for a document: the flagship's duplicate rule.
_WINDOW = "w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 22), lambda i: sha256(array_to_string(ws[i:i + 23], ' ')))) AS h FROM w WHERE len(ws) >= 24), dup AS (SELECT DISTINCT doc_id FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1))"


@query("slop_score", f"""WITH {DOC_LINES}, {_WINDOW}, wt AS {WEIGHTS},
found AS (SELECT doc_id, 'incompleteness' AS rule FROM l WHERE regexp_matches(line, '{_STUB}')
  UNION ALL SELECT doc_id, 'duplicate-block' FROM dup
  UNION ALL SELECT doc_id, 'magic-number' FROM (SELECT DISTINCT doc_id FROM l WHERE len(list_filter(regexp_extract_all(CASE WHEN instr(line, '#') > 0 THEN substr(line, 1, instr(line, '#') - 1) ELSE line END, '[A-Za-z0-9_]*-?[0-9][0-9.]*[A-Za-z_]?'), lambda x: regexp_full_match(x, '-?[0-9][0-9.]*') AND x NOT IN ('-1', '0', '1', '2', '0.0', '1.0', '2.0'))) > 0)),
p AS (SELECT doc_id, sum(weight) AS points, count(*) AS n FROM found JOIN wt USING (rule) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (trim(line) <> '') AS nonblank FROM l GROUP BY doc_id)
SELECT doc_id, nonblank, coalesce(n, 0) AS findings, round(CASE WHEN nonblank = 0 THEN 0 ELSE least(100.0, 100 * coalesce(CAST(points AS DOUBLE), 0) / nonblank) END, 6) AS score FROM b LEFT JOIN p USING (doc_id)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    shared = D.shared_windows(docs, "doc_id").where("shared > 0").select("doc_id", F.lit(1).alias("blocks"))
    return L.document_slop(docs, "doc_id", shared)


@query("inline_suppression", f"""WITH raw AS {literal_sql([('a.py', 1, 'x = 5  # lint-ignore magic-number -- known'), ('a.py', 2, 'y = 6'), ('a.py', 3, 'z = 7'), ('b.py', 1, '# lint-ignore *'), ('b.py', 2, 'w = 8')], 'path, line_no, line')}, fs AS {literal_sql([('a.py', 1, 'magic-number'), ('a.py', 2, 'magic-number'), ('a.py', 2, 'other'), ('a.py', 3, 'magic-number'), ('b.py', 2, 'other'), ('c.py', 1, 'other')], 'path, line_no, rule')},
dr AS (SELECT path, line_no, unnest(regexp_split_to_array(trim(regexp_replace(regexp_extract(line, 'lint-ignore\\s+([^\\n]*)', 1), '--.*$', '')), '[,\\s]+')) AS rule FROM raw WHERE regexp_extract(line, 'lint-ignore\\s+([^\\n]*)', 1) <> '')
SELECT path, CAST(line_no AS BIGINT) AS line_no, rule FROM fs WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.path = fs.path AND fs.line_no IN (dr.line_no, dr.line_no + 1) AND dr.rule IN (fs.rule, '*'))""")
def _(spark, d):
    raw = spark.createDataFrame([("a.py", 1, "x = 5  # lint-ignore magic-number -- known"), ("a.py", 2, "y = 6"), ("a.py", 3, "z = 7"), ("b.py", 1, "# lint-ignore *"), ("b.py", 2, "w = 8")], "path string, line_no long, line string")
    found = spark.createDataFrame([("a.py", 1, "magic-number"), ("a.py", 2, "magic-number"), ("a.py", 2, "other"), ("a.py", 3, "magic-number"), ("b.py", 2, "other"), ("c.py", 1, "other")], "path string, line_no long, rule string")
    return L.unsuppressed(found, L.suppressions(raw)).select("path", "line_no", "rule")


_RUST = [("a.rs", 1, "let v = xs.iter().map(|x| parse(x));"), ("a.rs", 2, "let w = xs.iter().map(|x| parse(x, 1));"), ("a.rs", 3, "ys.filter(|y| is_ok(z))"), ("a.rs", 4, "ys.for_each(|y| self::show(y));")]


@query("single_use_binding", f"WITH {CODE}, b AS (SELECT path, line_no, regexp_extract(line, '\\(let\\s+\\[\\s*([A-Za-z_][A-Za-z0-9_]*)\\s+([^\\]\\n]+)\\]\\s+([^)]+)\\)', 1) AS name, regexp_extract(line, '\\(let\\s+\\[\\s*([A-Za-z_][A-Za-z0-9_]*)\\s+([^\\]\\n]+)\\]\\s+([^)]+)\\)', 3) AS body FROM l WHERE lang = 'clojure') SELECT path, line_no, name FROM b WHERE name <> '' AND len(list_filter(regexp_extract_all(body, '[A-Za-z0-9_!?*<>=/+-]+'), lambda t: t = name)) = 1")
def _(spark, d):
    return L.single_use_bindings(code_lines(spark))


@query("redundant_closure", f"WITH r AS {literal_sql(_RUST, 'path, line_no, line')}, p AS (SELECT *, '\\|\\s*([a-z_][a-z0-9_]*)\\s*\\|\\s*([A-Za-z_][A-Za-z0-9_:]*)\\(\\s*([a-z_][a-z0-9_]*)\\s*\\)' AS x FROM r) SELECT path, line_no, regexp_extract(line, '\\|\\s*([a-z_][a-z0-9_]*)\\s*\\|\\s*([A-Za-z_][A-Za-z0-9_:]*)\\(\\s*([a-z_][a-z0-9_]*)\\s*\\)', 2) AS callee FROM p WHERE regexp_extract(line, '\\|\\s*([a-z_][a-z0-9_]*)\\s*\\|\\s*([A-Za-z_][A-Za-z0-9_:]*)\\(\\s*([a-z_][a-z0-9_]*)\\s*\\)', 1) = regexp_extract(line, '\\|\\s*([a-z_][a-z0-9_]*)\\s*\\|\\s*([A-Za-z_][A-Za-z0-9_:]*)\\(\\s*([a-z_][a-z0-9_]*)\\s*\\)', 3) AND regexp_matches(line, x)")
def _(spark, d):
    rows = spark.createDataFrame(_RUST, "path string, line_no long, line string").withColumn("lang", F.lit("rust"))
    return L.redundant_closures(rows)


_RET = [("a.rs", "rust", "fn a() -> u8 {\n    return 1;\n}\n"), ("b.rs", "rust", "fn b() -> u8 {\n    if x { return 2; }\n    3\n}\n"), ("c.rs", "rust", "fn c() {\n  let y = 1;\n  return y + 1; }")]


@query("needless_return", f"SELECT path, unnest(regexp_extract_all(text, 'return\\s+([^;{{}}]+);\\s*\\}}\\s*(?:\\n|$)', 1)) AS returned FROM {literal_sql(_RET, 'path, lang, text')} AS f")
def _(spark, d):
    return L.needless_returns(spark.createDataFrame(_RET, "path string, lang string, text string"))


@query("long_method", f"WITH {DOC_LINES} SELECT doc_id, count(*) FILTER (trim(line) <> '') AS nloc FROM l GROUP BY doc_id HAVING count(*) FILTER (trim(line) <> '') >= 40")
def _(spark, d):
    """Documents as regions: those of forty lines or more."""
    lines = L.plain_lines(table(spark, d, "documents"), "doc_id")
    return L.long_regions(lines.groupBy("doc_id").agg(F.count_if(F.trim("line") != "").alias("nloc")))


@query("uri_decoding", "SELECT page_id, url_decode(replace(url, '+', '%2B')) AS decoded FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))).alias("decoded"))
