"""Queries of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import graphs as G
from textloom.plans.registry import literal_sql, query, table

#: Imports among modules of our own making, with a ring, a pair, a self-loop and tails: (a, b, api, flow).
EDGES = [("app", "pricing", 1, 2), ("app", "report", 0, 1), ("pricing", "store", 3, 1), ("store", "rules", 1, 0), ("rules", "pricing", 0, 4), ("report", "store", 1, 1), ("report", "format", 0, 0), ("format", "report", 2, 2), ("mesh", "mesh", 0, 0), ("mesh", "format", 1, 0), ("cli", "app", 1, 1), ("cli", "mesh", 0, 1), ("store", "disk", 2, 2), ("tests", "app", 0, 0), ("alone", "island", 0, 0)]
FILES = [("app", "top"), ("cli", "top"), ("tests", "top"), ("pricing", "core"), ("store", "core"), ("rules", "core"), ("disk", "io"), ("report", "io"), ("format", "io"), ("mesh", "extra"), ("alone", "extra"), ("island", "extra")]
E_SQL, F_SQL = literal_sql(EDGES, "a, b, api, flow"), literal_sql(FILES, "node, module")
_E = f"e AS {E_SQL}, nd AS (SELECT node FROM {F_SQL} AS f)"
_CLOSE = f"WITH RECURSIVE {_E}, c AS (SELECT DISTINCT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"
_SCC = f"{_CLOSE}, s AS (SELECT nd.node, least(nd.node, coalesce(min(x.b), nd.node)) AS component FROM nd LEFT JOIN (SELECT p.a, p.b FROM c p JOIN c q ON p.a = q.b AND p.b = q.a) x ON x.a = nd.node GROUP BY nd.node), sz AS (SELECT component, count(*) AS size FROM s GROUP BY component), sc AS (SELECT node, component, size, size > 1 AS cyclic FROM s JOIN sz USING (component)), cd AS (SELECT p.component AS from_, q.component AS to_, count(*) AS n, list_sort(list(DISTINCT e.a)) AS sources FROM e JOIN sc p ON p.node = e.a JOIN sc q ON q.node = e.b WHERE p.component <> q.component GROUP BY ALL)"
_LAYER = f"{_SCC}, ly AS (SELECT DISTINCT component, 0 AS layer FROM sc UNION SELECT cd.from_, layer + 1 FROM ly JOIN cd ON cd.to_ = component), la AS (SELECT component, max(layer) AS layer FROM ly GROUP BY component)"


def _edges(spark):
    return spark.createDataFrame(EDGES, "a string, b string, api int, flow int")


def _nodes(spark):
    return spark.createDataFrame(FILES, "node string, module string").select("node")


def _files(spark):
    return spark.createDataFrame(FILES, "node string, module string")


@query("graph_closure", f"{_CLOSE} SELECT a, b FROM c")
def _(spark, d):
    return G.closure(_edges(spark))


@query("reachability", f"WITH RECURSIVE {_E}, r AS (SELECT 'cli' AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def _(spark, d):
    return G.reachable(_edges(spark), spark.createDataFrame([("cli",)], "node string"))


@query("transitive_dependents", f"WITH RECURSIVE {_E}, r AS (SELECT 'store' AS node UNION SELECT e.a FROM r JOIN e ON e.b = r.node) SELECT node FROM r")
def _(spark, d):
    return G.reachable(_edges(spark).select(F.col("b").alias("a"), F.col("a").alias("b")), spark.createDataFrame([("store",)], "node string"))


@query("impact_cone", f"WITH RECURSIVE {_E}, r AS (SELECT 'app' AS node, 0 AS k UNION ALL SELECT e.b, k + 1 FROM r JOIN e ON e.a = r.node WHERE k < 2), x AS (SELECT node, min(k) AS distance FROM r GROUP BY node) SELECT node, distance, distance = 2 AND EXISTS (SELECT 1 FROM e WHERE e.a = x.node AND e.b NOT IN (SELECT node FROM x)) AS truncated FROM x")
def _(spark, d):
    return G.distances(_edges(spark), spark.createDataFrame([("app",)], "node string"), 2)


@query("strong_components", f"{_SCC} SELECT node, component, size, cyclic FROM sc")
def _(spark, d):
    return G.strong_components(_nodes(spark), _edges(spark))


@query("condensation_edges", f"{_SCC} SELECT from_, to_, n, array_to_string(sources, ',') AS sources FROM cd")
def _(spark, d):
    out = G.condensation(_edges(spark), G.strong_components(_nodes(spark), _edges(spark)))
    return out.withColumn("sources", F.array_join("sources", ","))


@query("layers", f"{_LAYER} SELECT component, layer FROM la")
def _(spark, d):
    c = G.kept(G.strong_components(_nodes(spark), _edges(spark)))
    return G.layers(c, G.kept(G.condensation(_edges(spark), c)))


@query("shortest_paths", f"WITH RECURSIVE {_E}, r AS (SELECT 'cli' AS node, 0 AS k, ['cli'] AS path UNION ALL SELECT e.b, k + 1, list_append(path, e.b) FROM r JOIN e ON e.a = r.node WHERE NOT list_contains(path, e.b)), m AS (SELECT node, min(k) AS distance FROM r GROUP BY node) SELECT node, distance, array_to_string(min(path), '>') AS path FROM r JOIN m USING (node) WHERE k = distance GROUP BY ALL")
def _(spark, d):
    return G.shortest_paths(_edges(spark), "cli").withColumn("path", F.array_join("path", ">"))


@query("instability", f"WITH {_E}, x AS (SELECT DISTINCT a, b FROM e WHERE a <> b) SELECT node, (SELECT count(*) FROM x WHERE b = node) AS fan_in, (SELECT count(*) FROM x WHERE a = node) AS fan_out, round((SELECT count(*) FROM x WHERE a = node) / nullif((SELECT count(*) FROM x WHERE node IN (a, b)), 0), 6) AS instability FROM nd")
def _(spark, d):
    return G.instability(_nodes(spark), _edges(spark))


@query("architecture_rules", f"{_LAYER}, el AS (SELECT e.a, e.b, p.component AS ca, q.component AS cb FROM e JOIN sc p ON p.node = e.a JOIN sc q ON q.node = e.b), x AS (SELECT DISTINCT a, b FROM e WHERE a <> b), st AS (SELECT node, (SELECT count(*) FROM x WHERE a = node) AS o, (SELECT count(*) FROM x WHERE node IN (a, b)) AS t FROM nd) SELECT 'no-cycles' AS rule, a, b FROM el JOIN sc ON sc.node = a WHERE ca = cb AND cyclic AND a <> b UNION ALL SELECT 'forbid-tests-to-core', a, b FROM c WHERE a = 'tests' AND b = 'store' UNION ALL SELECT 'stable-direction', x.a, x.b FROM x JOIN st p ON p.node = x.a JOIN st q ON q.node = x.b WHERE p.o * q.t < q.o * p.t UNION ALL SELECT 'layer-descent', a, b FROM el JOIN la p ON p.component = ca JOIN la q ON q.component = cb WHERE ca <> cb AND p.layer <= q.layer")
def _(spark, d):
    """Rules over a module graph: no cycles, a forbidden dependency (also by way of others), layers that descend, and
    dependencies towards stability, compared as exact ratios."""
    e, n = _edges(spark), _nodes(spark)
    c = G.kept(G.strong_components(n, e))
    lay = G.layers(c, G.kept(G.condensation(e, c)))
    own = c.join(lay, "component").select("node", "component", "cyclic", "layer")
    el = e.join(own.toDF("a", "ca", "cyclic", "la"), "a").join(own.toDF("b", "cb", "x", "lb"), "b")
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "a", "b")
    s = G.instability(n, e)
    x = e.where("a <> b").select("a", "b").distinct().join(s.toDF("a", "ai", "ao", "r1"), "a").join(s.toDF("b", "bi", "bo", "r2"), "b")
    wide = "decimal(18,0)"
    less = F.col("ao").cast(wide) * (F.col("bi") + F.col("bo")).cast(wide) < F.col("bo").cast(wide) * (F.col("ai") + F.col("ao")).cast(wide)
    forbidden = G.closure(e).where("a = 'tests' AND b = 'store'")
    return rule(el.where("ca = cb AND cyclic AND a <> b"), "no-cycles").unionByName(rule(forbidden, "forbid-tests-to-core")).unionByName(rule(x.where(less), "stable-direction")).unionByName(rule(el.where("ca <> cb AND la <= lb"), "layer-descent"))


@query("cycle_seams", f"{_SCC} SELECT p.component, e.a, e.b, api, flow, row_number() OVER (PARTITION BY p.component ORDER BY api, flow, e.a, e.b) AS rank FROM e JOIN sc p ON p.node = e.a JOIN sc q ON q.node = e.b WHERE p.component = q.component AND p.cyclic AND e.a <> e.b")
def _(spark, d):
    return G.seam_ranks(_edges(spark), G.strong_components(_nodes(spark), _edges(spark)))


_MOD = f"WITH {_E}, m AS {F_SQL}, x AS (SELECT DISTINCT a, b FROM e WHERE a <> b), w AS (SELECT x.*, p.module AS f, q.module AS t FROM x JOIN m p ON p.node = x.a JOIN m q ON q.node = x.b)"


@query("module_profiles", f"{_MOD} SELECT module, count(*) AS files, (SELECT count(*) FROM w WHERE f = module AND t = module) AS internal, (SELECT count(*) FROM w WHERE f = module AND t <> module) AS outgoing, (SELECT count(*) FROM w WHERE f <> module AND t = module) AS incoming, CASE WHEN count(*) > 1 THEN (SELECT count(*) FROM w WHERE f = module AND t = module) END AS cohesion_num, CASE WHEN count(*) > 1 THEN count(*) * (count(*) - 1) END AS cohesion_den FROM m GROUP BY module")
def _(spark, d):
    return G.module_profiles(_files(spark), _edges(spark))


@query("parent_dependencies", f"{_MOD} SELECT f AS from_, t AS to_, count(*) AS evidence FROM w WHERE f <> t GROUP BY ALL")
def _(spark, d):
    return G.lifted(_edges(spark).select("a", "b"), _files(spark))


@query("module_restructure")
def _(spark, d):
    return G.restructurings(_files(spark), _edges(spark))


_TREE = [(k, None if k == 1 else k // 2, k * 3 % 7 + 1, k % 5 == 0) for k in range(1, 40)]


@query("subtree_aggregates", f"WITH RECURSIVE t AS {literal_sql(_TREE, 'node, parent, value, reset')}, u AS (SELECT node, node AS above FROM t UNION SELECT u.node, p.parent FROM u JOIN t p ON p.node = u.above WHERE p.parent IS NOT NULL AND NOT p.reset) SELECT above AS node, (SELECT value FROM t WHERE t.node = above) AS exclusive, CAST(sum(value) AS BIGINT) AS inclusive FROM u JOIN t USING (node) GROUP BY above")
def _(spark, d):
    return G.subtree_totals(spark.createDataFrame(_TREE, "node long, parent long, value long, reset boolean"))


@query("weak_components", "WITH RECURSIVE x AS (SELECT DISTINCT n.n_nationkey AS a, 1000 + n_regionkey AS b FROM nation n), y AS (SELECT a, b FROM x UNION SELECT b, a FROM x), c AS (SELECT a AS node, a AS low FROM y UNION SELECT y.b, c.low FROM c JOIN y ON y.a = c.node) SELECT node, min(low) AS component FROM c GROUP BY node")
def _(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 1000).cast("long").alias("b"))
    return G.weak_components(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), e)


@query("duplicate_text_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def _(spark, d):
    """Components of the graph that ties each text's first holder to its others."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    e = docs.join(first, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return G.weak_components(docs.select(F.col("doc_id").alias("node")), e)


@query("page_link_graph", "WITH p AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) SELECT host, link, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return p.groupBy("host", "link").agg(F.count("*").alias("n"))


@query("graph_summary", f"SELECT CASE WHEN a = b THEN 'self' WHEN api > 0 THEN 'api' ELSE 'plain' END AS kind, count(*) AS n FROM {E_SQL} AS e GROUP BY 1")
def _(spark, d):
    return _edges(spark).groupBy(F.when(F.col("a") == F.col("b"), "self").when(F.col("api") > 0, "api").otherwise("plain").alias("kind")).agg(F.count("*").alias("n"))


_REFS = [("f1", "app.run", "core"), ("f2", "run", "app"), ("f3", "missing", "app"), ("f4", "twice", "core"), ("f5", "core.load", "app"), ("f6", "load", "core")]
_DEFS = [("app", "run"), ("core", "load"), ("core", "twice"), ("app", "twice"), ("io", "twice")]


@query("symbol_resolution", f"""WITH r AS {literal_sql(_REFS, 'ref, label, scope')}, df AS {literal_sql(_DEFS, 'module, name')},
q AS (SELECT *, list_filter(regexp_split_to_array(label, '::|\\.|/'), lambda x: trim(x) <> '') AS seg FROM r),
n AS (SELECT ref, 1 AS k, df.module || '.' || df.name AS target FROM q JOIN df ON len(seg) = 1 AND df.module = scope AND df.name = seg[1]
  UNION ALL SELECT ref, 2, df.module || '.' || df.name FROM q JOIN df ON len(seg) > 1 AND df.module = seg[-2] AND df.name = seg[-1]
  UNION ALL SELECT ref, 3, df.module || '.' || df.name FROM q JOIN df ON len(seg) = 1 AND df.name = seg[1]),
b AS (SELECT ref, min(k) AS k FROM n GROUP BY ref)
SELECT r.ref, count(DISTINCT target) AS candidates, CASE count(DISTINCT target) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'syntactic' ELSE 'ambiguous' END AS confidence, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM r LEFT JOIN (SELECT n.* FROM n JOIN b USING (ref, k)) x ON x.ref = r.ref GROUP BY r.ref""")
def _(spark, d):
    """References by nearest scope, then by qualified module, then by name anywhere: the first way with a candidate counts."""
    from textloom.functions import text as X

    refs = spark.createDataFrame(_REFS, "ref string, label string, scope string").withColumn("seg", X.qualified_segments(F.col("label")))
    defs = spark.createDataFrame(_DEFS, "module string, name string")
    last, owner = F.element_at("seg", -1), F.get("seg", F.size("seg") - 2)
    one = F.size("seg") == 1
    ways = [refs.join(defs, one & (F.col("module") == F.col("scope")) & (F.col("name") == last)), refs.join(defs, ~one & (F.col("module") == owner) & (F.col("name") == last)), refs.join(defs, one & (F.col("name") == last))]
    found = None
    for k, way in enumerate(ways):
        part = way.select("ref", F.lit(k).alias("k"), F.concat_ws(".", "module", "name").alias("target"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("ref").agg(F.min("k").alias("k")).join(found, ["ref", "k"]).groupBy("ref").agg(F.count_distinct("target").alias("n"), F.min("target").alias("t"))
    n = F.coalesce("n", F.lit(0))
    return refs.join(best, "ref", "left").select("ref", n.alias("candidates"), F.when(n == 0, "unresolved").when(n == 1, "syntactic").otherwise("ambiguous").alias("confidence"), F.when(n == 1, F.col("t")).alias("target"))


# Graphs of the tables: parties and parts of trade, whose edges grow with the orders.
_TRADE = """e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""


def trade(spark, d):
    """customer -> order -> part -> supplier."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = table(spark, d, "lineitem")
    edges = table(spark, d, "orders").select(name("c", "o_custkey").alias("a"), name("o", "o_orderkey").alias("b"))
    return edges.unionByName(lines.select(name("o", "l_orderkey").alias("a"), name("p", "l_partkey").alias("b"))).unionByName(lines.select(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b"))).distinct()


@query("trade_reachability", f"WITH RECURSIVE {_TRADE}, r AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_nationkey = 7 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT substr(node, 1, 1) AS kind, count(*) AS reached FROM r GROUP BY 1")
def _(spark, d):
    """What the customers of one nation have bought, and from whom."""
    roots = table(spark, d, "customer").where("c_nationkey = 7").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return G.reachable(trade(spark, d), roots).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("reached"))


@query("trade_impact", f"WITH {_TRADE}, z AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1), x AS (SELECT DISTINCT a AS node FROM e JOIN z ON e.b = z.node), y AS (SELECT DISTINCT a AS node FROM e JOIN x ON e.b = x.node) SELECT distance, count(*) AS n FROM (SELECT node, min(k) AS distance FROM (SELECT node, 0 AS k FROM z UNION ALL SELECT node, 1 FROM x UNION ALL SELECT node, 2 FROM y) GROUP BY node) GROUP BY distance")
def _(spark, d):
    """Orders and customers within two steps of the parts of one size, against the edges."""
    roots = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return G.distances(trade(spark, d).toDF("b", "a"), roots, 2).groupBy("distance").agg(F.count("*").alias("n"))


_PLACES = "e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def places(spark, d):
    """customer -> nation -> region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, d, "customer").select(name("c", "c_custkey").alias("a"), name("n", "c_nationkey").alias("b")).unionByName(table(spark, d, "nation").select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b")))


def _ends(edges):
    return edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()


@query("place_layers", f"WITH {_PLACES}, l AS (SELECT b AS node, 0 AS layer FROM e WHERE b LIKE 'r%' UNION SELECT a, 1 FROM e WHERE a LIKE 'n%' UNION SELECT a, 2 FROM e WHERE a LIKE 'c%') SELECT layer, count(DISTINCT node) AS n FROM l GROUP BY layer")
def _(spark, d):
    e = places(spark, d)
    c = G.strong_components(_ends(e), e)
    return G.layers(c, G.condensation(e, c)).groupBy("layer").agg(F.count("*").alias("n"))


@query("place_components", f"WITH {_PLACES}, m AS (SELECT e.a AS node, coalesce(u.b, e.b) AS top FROM e LEFT JOIN e u ON u.a = e.b UNION SELECT b, b FROM e WHERE b LIKE 'r%') SELECT top AS region, count(*) AS n FROM m GROUP BY top")
def _(spark, d):
    """Weak components, named by their region, and their sizes."""
    e = places(spark, d)
    c = G.weak_components(_ends(e), e)
    tops = c.where("node LIKE 'r%'").select(F.col("node").alias("region"), "component")
    return c.join(tops, "component").groupBy("region").agg(F.count("*").alias("n"))


_CYCLIC = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS b FROM lineitem)"


@query("supplier_cycles", f"WITH RECURSIVE {_CYCLIC}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), k AS (SELECT DISTINCT a AS node FROM e UNION SELECT b FROM e), c AS (SELECT k.node, least(k.node, coalesce(min(x.b), k.node)) AS component FROM k LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) x ON x.a = k.node GROUP BY k.node) SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) > 1")
def _(spark, d):
    """Components of more than one supplier in a graph of suppliers that cycles; SQL goes by closure, which is all pairs."""
    most = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("most"))
    e = table(spark, d, "lineitem").crossJoin(F.broadcast(most)).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % F.col("most") + 1).alias("b")).distinct()
    return G.strong_components(_ends(e), e).where("cyclic").select("component", "size").distinct()
