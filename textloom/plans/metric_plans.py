"""Queries of metrics over documents and code."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import lines as L
from textloom.operators import metrics as M
from textloom.operators.surprisal import surprisal
from textloom.plans.line_plans import MARKED, code_lines
from textloom.plans.registry import literal_sql, query, table
from textloom.sources.shared import spread

WORD = "[A-Za-z0-9_]+"
COUNTS = f"tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS token FROM documents), ct AS (SELECT doc_id, token, count(*) AS n FROM tk GROUP BY doc_id, token)"
INFO = f"{COUNTS}, e AS (SELECT doc_id, sum(n) AS tokens, count(*) AS vocabulary, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h FROM ct GROUP BY doc_id)"


def word_counts(spark, d):
    words = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("token_information", f"WITH {INFO} SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, vocabulary, round(h, 6) AS entropy, round(CASE WHEN vocabulary <= 1 THEN 0 ELSE least(1, h / log2(vocabulary)) END, 6) AS normalized, round(h * tokens, 4) AS volume FROM e")
def _(spark, d):
    return M.entropy(word_counts(spark, d), ["doc_id"])


@query("byte_entropy", "WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(0, len(x) // 2), lambda i: substr(x, 2 * i + 1, 2))) AS b FROM h), c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY doc_id, b) SELECT doc_id, round(greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS byte_entropy FROM c GROUP BY doc_id")
def _(spark, d):
    return M.byte_entropy(table(spark, d, "documents"), "doc_id")


# fixed values: operators of the token metrics by language
PY_OPERATORS = "= + - * / % == != < > <= >= and or not if elif else for while return raise".split()


@query("halstead", f"WITH {MARKED}, t AS (SELECT path, unnest(regexp_extract_all(code, '{X.TOKEN}')) AS token FROM k WHERE lang = 'python'), o AS (SELECT *, token IN ({', '.join(repr(x) for x in PY_OPERATORS)}) AS op FROM t), g AS (SELECT path, count(DISTINCT token) FILTER (op) AS n1, count(DISTINCT token) FILTER (NOT op) AS n2, count(*) FILTER (op) AS total_operators, count(*) FILTER (NOT op) AS total_operands FROM o GROUP BY path), v AS (SELECT *, (total_operators + total_operands) * log2(n1 + n2) AS vol, CASE WHEN n2 > 0 THEN n1 / 2.0 * total_operands / n2 ELSE 0 END AS dif FROM g) SELECT path, n1, n2, total_operators, total_operands, round(vol, 4) AS volume, round(CAST(dif AS DOUBLE), 4) AS difficulty, round(vol * dif, 2) AS effort FROM v")
def _(spark, d):
    tokens = L.tokens_of(code_lines(spark).where("lang = 'python'"), "path", lang=F.lit("python"))
    return M.halstead(tokens.where("NOT is_comment"), ["path"], PY_OPERATORS)


@query("expressivity", f"WITH {INFO}, s AS (SELECT doc_id, len(text) - len(replace(text, '|', '')) AS bars, len(string_split(text, chr(10))) AS nloc FROM documents) SELECT doc_id, round(vocabulary / tokens, 6) AS unique_token_ratio, round(bars / nloc, 6) AS decision_density FROM e JOIN s USING (doc_id)")
def _(spark, d):
    info = M.entropy(word_counts(spark, d), ["doc_id"])
    s = table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).alias("bars"), F.size(F.split("text", "\n")).alias("nloc"))
    return info.join(s, "doc_id").select("doc_id", F.round(X.ratio(F.col("vocabulary"), F.col("tokens")), 6).alias("unique_token_ratio"), F.round(X.ratio(F.col("bars"), F.col("nloc")), 6).alias("decision_density"))


@query("maintainability_index", f"WITH {INFO}, s AS (SELECT doc_id, len(string_split(text, chr(10))) AS nloc FROM documents) SELECT doc_id, round(greatest(0, least(100, (171 - 5.2 * ln(greatest(round(h * tokens, 4), 1)) - 0.23 * 3 - 16.2 * ln(nloc)) * 100 / 171)), 6) AS mi, round(3 * sqrt(nloc), 6) AS mass, round(ln(1 + 3 * sqrt(nloc)), 6) AS log_mass FROM e JOIN s USING (doc_id)")
def _(spark, d):
    info = M.entropy(word_counts(spark, d), ["doc_id"]).select("doc_id", "volume")
    s = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("nloc"))
    mass = 3 * F.sqrt("nloc")
    return info.join(s, "doc_id").select("doc_id", F.round(X.maintainability(F.col("volume"), F.lit(3), F.col("nloc")), 6).alias("mi"), F.round(mass, 6).alias("mass"), F.round(F.log1p(mass), 6).alias("log_mass"))


_PAIRS = f"tk AS (SELECT doc_id, lang, regexp_extract_all(text, '{WORD}') AS ts FROM documents), ix AS (SELECT doc_id AS region, lang, unnest(ts) AS token, unnest(list_concat(['<START>'], ts[:-2])) AS ctx FROM tk WHERE len(ts) > 0), pr AS (SELECT lang, region, ctx, token, count(*) AS n FROM ix GROUP BY ALL)"


@query("surprisal", f"""WITH {_PAIRS}, pa AS (SELECT lang, ctx, token, sum(n) AS pair_all FROM pr GROUP BY ALL), ca AS (SELECT lang, ctx, sum(n) AS ctx_all FROM pr GROUP BY ALL), co AS (SELECT lang, region, ctx, sum(n) AS ctx_own FROM pr GROUP BY ALL), v AS (SELECT lang, count(DISTINCT token) AS v, sum(n) AS every FROM pr GROUP BY lang), ow AS (SELECT lang, region, sum(n) AS own FROM pr GROUP BY ALL),
b AS (SELECT lang, region, n, round(-log2((pair_all - n + 1) / (ctx_all - ctx_own + v + 1)), 9) AS bits FROM pr JOIN pa USING (lang, ctx, token) JOIN ca USING (lang, ctx) JOIN co USING (lang, region, ctx) JOIN v USING (lang) JOIN ow USING (lang, region) WHERE every > own),
x AS (SELECT lang, region, bits, unnest(range(0, n)) FROM b)
SELECT lang, region, round(avg(bits), 6) AS mean, round(quantile_cont(bits, 0.9), 6) AS p90, max(round(bits, 6)) AS most FROM x GROUP BY lang, region""")
def _(spark, d):
    return surprisal(table(spark, d, "documents"), "doc_id")


@query("robust_z", "WITH g AS (SELECT doc_id, lang, source, n_chars, median(n_chars) OVER w AS med, count(*) OVER w AS peers FROM documents WINDOW w AS (PARTITION BY lang, source)), m AS (SELECT *, median(abs(n_chars - med)) OVER (PARTITION BY lang, source) AS mad FROM g), z AS (SELECT doc_id, med AS median, mad, CASE WHEN peers >= 8 AND mad > 1e-12 THEN (n_chars - med) / (1.4826 * mad) END AS z FROM m) SELECT doc_id, CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, round(z, 6) AS z, round(CASE WHEN z IS NULL THEN 0 ELSE greatest(0, z) END, 6) AS excess FROM z")
def _(spark, d):
    return M.robust_z(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars").select("doc_id", "median", "mad", "z", "excess")


@query("midrank_percentile", "WITH r AS (SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY n_chars) AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars, round(CASE WHEN n <= 1 THEN 0.5 ELSE (2 * r + p - 3) / 2 / (n - 1) END, 6) AS percentile FROM r")
def _(spark, d):
    return M.midrank_percentiles(table(spark, d, "documents"), "n_chars", "doc_id")


@query("linear_quantiles", "SELECT lang, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, round(stddev_pop(n_chars), 6) AS deviation FROM documents GROUP BY lang")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.struct("lang").alias("g"), "lang", "n_chars")
    deviation = docs.groupBy("g").agg(F.round(F.stddev_pop("n_chars"), 6).alias("deviation"))
    found = M.group_quantiles(docs, ["lang"], "n_chars", [0.25, 0.5, 0.9]).toDF("lang", "count", "p25", "p50", "p90")
    return deviation.join(found.withColumn("g", F.struct("lang")).drop("lang"), "g", "left").select("g.lang", "p25", "p50", "p90", "deviation")


@query("peer_groups", "SELECT lower(lang || '/' || source || '/' || CASE WHEN n <= 15 THEN '0-15' WHEN n <= 31 THEN '16-31' WHEN n <= 63 THEN '32-63' WHEN n <= 127 THEN '64-127' ELSE '128+' END) AS peer, count(*) AS members FROM (SELECT lang, source, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", X.size_bin(F.size(F.split("text", "\n"))).alias("bin"))
    return rows.groupBy(F.lower(F.concat_ws("/", "lang", "source", "bin")).alias("peer")).agg(F.count("*").alias("members"))


_REGION = f"""{INFO}, s AS (SELECT doc_id, len(string_split(text, chr(10))) AS nloc, len(regexp_extract_all(text, '[,;]')) AS branches FROM documents),
rg AS (SELECT doc_id, tokens, CASE WHEN vocabulary <= 1 THEN 0 ELSE least(1, h / log2(vocabulary)) END AS te, h * tokens AS vol, nloc, CAST(branches AS DOUBLE) AS cognitive, 1.0 + branches // 4 AS cyclomatic, branches % 5 AS nesting, nloc * 4 AS nodes FROM e JOIN s USING (doc_id)),
sat AS (SELECT *, 0.5 * (cognitive / (cognitive + 10)) + 0.3 * ((cyclomatic - 1) / (cyclomatic - 1 + 8)) + 0.2 * (nesting / (nesting + 4)) AS cb, vol / (vol + 512) AS ib, nodes / (nodes + 32) AS ss FROM rg),
e2 AS (SELECT *, 0.6 * (1 - te) * (tokens / (tokens + 16)) + 0.4 * te * ss * cb AS eb, cb * (0.65 * ib + 0.35 * te) AS xb FROM sat),
bd AS (SELECT *, round(greatest(0, least(1, greatest(0, least(1, 0.45 * cb + 0.2 * ib + 0.15 * eb + 0.2 * xb)) * (0.5 + greatest(tokens / (tokens + 64), nloc / (nloc + 20))))) * greatest(0, least(0.95, 0.2 + 0.45 * (tokens / (tokens + 32)) + 0.3 * ss)), 6) AS burden FROM e2)"""


def regions(spark, d):
    """Documents as regions; punctuation stands in for branches, which prose has none of."""
    info = M.entropy(word_counts(spark, d), ["doc_id"])
    branches = F.size(F.regexp_extract_all("text", F.lit("([,;])"), F.lit(1)))
    s = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("nloc"), branches.alias("branches"))
    rows = info.join(s, "doc_id")
    return rows.select("doc_id", "tokens", F.col("normalized").alias("token_entropy"), F.col("normalized").alias("structural_entropy"), F.col("volume").alias("information_volume"), "nloc", F.col("branches").cast("double").alias("cognitive"), (1.0 + F.floor(F.col("branches") / 4)).alias("cyclomatic"), (F.col("branches") % 5).alias("max_nesting"), (F.col("nloc") * 4).alias("nodes"))


@query("burden_score", f"WITH {_REGION} SELECT doc_id, round(burden, 4) AS burden FROM bd")
def _(spark, d):
    return M.burden(regions(spark, d)).select("doc_id", F.round("burden", 4).alias("burden"))


@query("burden_distribution", f"WITH {_REGION}, o AS (SELECT count(*) AS count, avg(burden) AS mean, median(burden) AS median, stddev_pop(burden) AS stddev, min(burden) AS low, max(burden) AS high, quantile_cont(burden, 0.25) AS p25, quantile_cont(burden, 0.75) AS p75 FROM bd) SELECT count, round(mean, 4) AS mean, round(median, 4) AS median, round(stddev, 4) AS stddev, high - low >= 0.05 AND stddev >= 0.01 AND count >= 8 AS eligible FROM o")
def _(spark, d):
    return M.distribution(M.burden(regions(spark, d)), "burden").select("count", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("stddev", 4).alias("stddev"), "eligible")


_LENGTHS = "x AS (SELECT doc_id, least(1.0, n_chars / 20000) AS v FROM documents)"


@query("burden_outliers", f"WITH {_LENGTHS}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS d, count(*) AS n, max(v) - min(v) AS r FROM x), k AS (SELECT doc_id, v, (2 * rank() OVER (ORDER BY v) + count(*) OVER (PARTITION BY v) - 3) / 2 / (count(*) OVER () - 1) AS p FROM x), z AS (SELECT doc_id, v, round((v - m) / d, 6) AS z, round(p, 6) AS percentile FROM k, s WHERE n >= 8 AND r >= 0.05 AND d >= 0.01) SELECT doc_id, round(v, 6) AS burden, z, percentile, row_number() OVER (ORDER BY v DESC, doc_id) AS rank FROM z WHERE z >= 1 AND percentile >= 0.9")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("burden"))
    return M.outliers(rows, "doc_id", "burden").withColumn("burden", F.round("burden", 6))


@query("hotspots", f"WITH {INFO}, s AS (SELECT doc_id, len(string_split(text, chr(10))) AS nloc, n_chars FROM documents), r AS (SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, nloc, n_chars, vocabulary / tokens AS utr FROM e JOIN s USING (doc_id)), st AS (SELECT median(nloc) AS nm, stddev_pop(nloc) AS ns, median(n_chars) AS cm, stddev_pop(n_chars) AS cs, median(utr) AS um, stddev_pop(utr) AS us FROM r), z AS (SELECT doc_id, tokens, (nloc - nm) / ns AS zn, (n_chars - cm) / cs AS zc, (um - utr) / us AS zu FROM r, st), f AS (SELECT doc_id, zn >= 2 AS hn, zc >= 2 AS hc, zu >= 2 AND tokens >= 16 AS hu, zn, zc, zu FROM z) SELECT doc_id, round((CASE WHEN hn THEN zn ELSE 0 END) + (CASE WHEN hc THEN zc ELSE 0 END) + (CASE WHEN hu THEN zu ELSE 0 END), 6) AS score, array_to_string(list_sort(list_filter([CASE WHEN hc THEN 'n_chars high' END, CASE WHEN hn THEN 'nloc high' END, CASE WHEN hu THEN 'unique_ratio low' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f WHERE hn OR hc OR hu")
def _(spark, d):
    info = M.entropy(word_counts(spark, d), ["doc_id"]).select("doc_id", "tokens", (F.col("vocabulary") / F.col("tokens")).alias("unique_ratio"))
    s = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("nloc"), "n_chars")
    return M.hotspots(info.join(s, "doc_id"), "doc_id", ["nloc", "n_chars"], ["unique_ratio"])


@query("file_rollup", "WITH r AS (SELECT source, len(string_split(text, chr(10))) AS nloc, 1 + len(regexp_extract_all(text, '[,;]')) // 4 AS cyclomatic FROM documents), m AS (SELECT *, cyclomatic * sqrt(nloc) AS mass FROM r) SELECT source, count(*) AS regions, CAST(sum(nloc) AS BIGINT) AS nloc, round(quantile_cont(cyclomatic, 0.9), 6) AS p90, round(sum(mass) FILTER (cyclomatic > 10) / sum(mass), 6) AS erosion, round(sum(cyclomatic * nloc) / sum(nloc), 6) AS weighted FROM m GROUP BY source")
def _(spark, d):
    r = table(spark, d, "documents").select("source", F.size(F.split("text", "\n")).alias("nloc"), (1 + F.floor(F.size(F.regexp_extract_all("text", F.lit("([,;])"), F.lit(1))) / 4)).alias("cyclomatic"))
    r = r.withColumn("mass", F.col("cyclomatic") * F.sqrt("nloc"))
    return r.groupBy("source").agg(F.count("*").alias("regions"), F.sum("nloc").alias("nloc"), F.round(F.percentile("cyclomatic", F.lit(0.9)), 6).alias("p90"), F.round(F.sum(F.when(F.col("cyclomatic") > 10, F.col("mass"))) / F.sum("mass"), 6).alias("erosion"), F.round(F.sum(F.col("cyclomatic") * F.col("nloc")) / F.sum("nloc"), 6).alias("weighted"))


@query("change_dispersion", "WITH c AS (SELECT date_trunc('month', l_shipdate) AS m, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY ALL), e AS (SELECT m, CAST(sum(n) AS BIGINT) AS changed, count(*) AS files, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h FROM c WHERE n > 0 GROUP BY m) SELECT strftime(m, '%Y-%m') AS month, changed, files, round(CASE WHEN files <= 1 THEN 0 ELSE least(1, h / log2(files)) END, 6) AS normalized FROM e")
def _(spark, d):
    c = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey", F.col("l_quantity").cast("long").alias("n"))
    return M.dispersion(c, ["month"], "l_partkey", "n")


_REG = [("a", "r1", 1, 10), ("a", "r2", 11, 20), ("b", "r1", 1, 4)]
_BAD = [("a", "clone", 3, 6), ("a", "clone", 5, 8), ("a", "dead", 6, 12), ("a", "pattern", 1, 1), ("b", "dead", 4, 90)]


@query("redundancy_union", f"WITH rg AS {literal_sql(_REG, 'path, region, a, z')}, bd AS {literal_sql(_BAD, 'path, waste, a, z')}, o AS (SELECT path, region, unnest(range(a, z + 1)) AS line FROM rg), w AS (SELECT path, waste, unnest(range(a, z + 1)) AS line FROM bd), h AS (SELECT path, region, count(DISTINCT line) AS lines, count(DISTINCT line) FILTER (waste = 'clone') AS clone, count(DISTINCT line) FILTER (waste = 'pattern') AS pattern, count(DISTINCT line) FILTER (waste = 'dead') AS dead FROM o JOIN w USING (path, line) GROUP BY ALL) SELECT path, region, coalesce(lines, 0) AS lines, coalesce(clone, 0) AS clone, coalesce(pattern, 0) AS pattern, coalesce(dead, 0) AS dead, round(coalesce(lines, 0) / (z - a + 1), 6) AS ratio FROM rg LEFT JOIN h USING (path, region)")
def _(spark, d):
    return M.redundancy(spark.createDataFrame(_REG, "path string, region string, start_line long, end_line long"), spark.createDataFrame(_BAD, "path string, waste string, start_line long, end_line long"))


@query("cfg_cyclomatic", "WITH s AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT user_id, src, dst FROM s WHERE dst IS NOT NULL), v AS (SELECT user_id, count(DISTINCT event_type) AS v FROM events GROUP BY user_id) SELECT user_id, count(src) AS edges, v AS points, greatest(1, count(src) - v + 2) AS cyclomatic FROM v LEFT JOIN e USING (user_id) GROUP BY user_id, v")
def _(spark, d):
    """E - V + 2 of each user's transition graph, which is connected, as it is one walk."""
    events = table(spark, d, "events")
    edges = M.transitions(events, "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("edges"))
    points = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("points"))
    e = F.coalesce("edges", F.lit(0))
    return points.join(edges, "user_id", "left").select("user_id", e.alias("edges"), "points", F.greatest(F.lit(1), e - F.col("points") + 2).alias("cyclomatic"))


@query("transition_graph", "WITH s AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT user_id, src, dst, count(*) AS n FROM s WHERE dst IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return M.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("text_calibration_features", f"WITH {INFO}, s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS nloc FROM documents) SELECT s.doc_id, nloc, round(CASE WHEN coalesce(vocabulary, 0) <= 1 THEN 0 ELSE least(1, h / log2(vocabulary)) END, 6) AS token_entropy FROM s LEFT JOIN e USING (doc_id)")
def _(spark, d):
    """Lines with more than spaces (any of Unicode's), and the entropy of words over its most; 0 where there is no word."""
    info = M.entropy(word_counts(spark, d), ["doc_id"]).select("doc_id", F.col("normalized").alias("token_entropy"))
    s = table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\p{Zs}]"))).alias("nloc"))
    return s.join(info, "doc_id", "left").select("doc_id", "nloc", F.coalesce("token_entropy", F.lit(0.0)).alias("token_entropy"))


@query("reference_popularity", f"WITH {COUNTS} SELECT token, count(*) AS holders, count(*) > 3 AS shared FROM ct GROUP BY token")
def _(spark, d):
    return word_counts(spark, d).groupBy("token").agg(F.count("*").alias("holders")).withColumn("shared", F.col("holders") > 3)


@query("lag_of_previous_token", "SELECT conv_id, turn, lag(role, 1, '<START>') OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role", 1, "<START>").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))
