"""Queries of syntax trees: over programs, one for each document, and over the small corpus where SQL has its nodes as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import graphs, resolution, syntax
from textloom.plans.registry import literal_sql, query, table
from textloom.sources import corpus, programs, trees

_COLUMNS = "path, node, parent, field, ordinal, kind, ctx, name, start_, end_, line, end_line, owner, regions, above, scope"
#: The small corpus' nodes, for SQL.
_ROWS = [(path, *row[:-1]) for path, lang, text in corpus.FILES + corpus.MODULES if lang == "python" for row in trees.tree(text)]
NODES = f"nd AS {literal_sql(_ROWS, _COLUMNS)}"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)


def small(spark):
    return trees.nodes(corpus.modules(spark))


def _programs(spark, d):
    """As many programs as there are documents."""
    return programs.programs(table(spark, d, "documents"), "doc_id")


def large(spark, d):
    """The nodes of as many programs as there are documents, parsed once."""
    return graphs.kept(trees.nodes(_programs(spark, d)))


@query("syntax_regions", f"WITH {NODES} SELECT path, node AS region, kind, name, scope, CASE kind WHEN 'Module' THEN 'file' WHEN 'ClassDef' THEN 'container' ELSE 'behavioral' END AS role, line AS start_line, end_line, end_line - line + 1 AS lines FROM nd WHERE node = owner")
def _(spark, d):
    return syntax.regions(small(spark))


@query("syntax_roles", f"WITH {NODES}, r AS {literal_sql([(k, r) for k, own in syntax.ROLES.items() for r in own], 'kind, role')} SELECT path, node, role FROM nd JOIN r USING (kind)")
def _(spark, d):
    return syntax.roles(small(spark))


@query("adapter_facts", f"""WITH {NODES}, c AS {literal_sql(list(syntax.REGION_CLASSES.items()), 'kind, region_class')}
SELECT path, node, region_class, CAST(kind IN ({_IN(syntax.BRANCHES)}) AS INT) AS branch, CAST(kind IN ({_IN(syntax.NESTING)}) AS INT) AS nesting, CAST(kind IN ({_IN(syntax.FLOW_BREAKS)}) AS INT) AS flow_break,
 field IN ('body', 'orelse', 'finalbody') AND ordinal = max(ordinal) OVER (PARTITION BY path, parent, field) AS tail FROM nd LEFT JOIN c USING (kind)""")
def _(spark, d):
    return syntax.adapter_facts(small(spark))


_ENTROPY = "round(CASE WHEN count(*) <= 1 THEN 0.0 ELSE greatest(0, least(1, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)))) END, 6)"


@query("ast_complexity", f"""WITH {NODES}, w AS (SELECT *, len(list_filter(above, lambda x: x IN ({_IN(syntax.NESTING)}))) AS deep, kind IN ({_IN(syntax.BRANCHES)}) AS b, kind IN ({_IN(syntax.NESTING)}) AS ne, kind IN ({_IN(syntax.FLOW_BREAKS)}) AS fb FROM nd),
s AS (SELECT path, owner AS region, count(*) AS nodes, count(*) FILTER (b) AS branches, CAST(coalesce(sum(1 + deep) FILTER (b), 0) + count(*) FILTER (fb) AS BIGINT) AS cognitive, CAST(max(deep + CAST(ne AS INT)) AS BIGINT) AS max_nesting FROM w GROUP BY path, owner),
k AS (SELECT path, owner AS region, {_ENTROPY} AS kind_entropy FROM (SELECT path, owner, kind, count(*) AS n FROM nd GROUP BY ALL) GROUP BY path, owner),
e AS (SELECT path, owner AS region, {_ENTROPY} AS edge_entropy FROM (SELECT path, owner, above[-1] || '>' || kind AS k, count(*) AS n FROM nd WHERE len(above) > 0 GROUP BY ALL) GROUP BY path, owner)
SELECT s.*, kind_entropy, coalesce(edge_entropy, 0.0) AS edge_entropy FROM s LEFT JOIN k USING (path, region) LEFT JOIN e USING (path, region)""")
def _(spark, d):
    return syntax.complexity(small(spark))


_BOUND = """ks AS (SELECT path, node AS scope_node, kind AS scope_kind FROM nd WHERE node = owner),
dc AS (SELECT path, CASE WHEN node = owner THEN regions[-2] ELSE owner END AS scope_node, CASE WHEN kind = 'alias' THEN regexp_replace(name, '\\..*$', '') ELSE name END AS name, node,
  CASE WHEN kind IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') THEN 'definition' WHEN kind = 'arg' THEN 'parameter' WHEN kind = 'alias' THEN 'import' ELSE 'assignment' END AS what
  FROM nd WHERE kind IN ('arg', 'alias') OR (kind = 'Name' AND ctx = 'Store') OR (node = owner AND kind IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef'))),
bd AS (SELECT path, scope_node, name, count(*) AS bindings, arg_min(what, node) AS what FROM dc GROUP BY ALL),
rd AS (SELECT path, node, name, unnest(list_reverse(regions)) AS scope_node, unnest(range(len(regions))) AS distance FROM nd WHERE kind = 'Name' AND ctx = 'Load'),
mt AS (SELECT rd.*, bindings, what FROM rd JOIN ks USING (path, scope_node) JOIN bd USING (path, scope_node, name) WHERE distance = 0 OR scope_kind <> 'ClassDef'),
tr AS (SELECT n.path, n.node, n.name, arg_min(m.scope_node, distance) AS scope_node, CAST(min(distance) AS INT) AS distance, arg_min(what, distance) AS what, arg_min(bindings, distance) AS bindings, greatest(0, count(m.node) - 1) AS shadowed
  FROM nd n LEFT JOIN mt m ON m.path = n.path AND m.node = n.node WHERE n.kind = 'Name' AND n.ctx = 'Load' GROUP BY ALL)"""


@query("scope_traversal", f"WITH {NODES}, {_BOUND} SELECT *, CASE WHEN bindings IS NULL THEN 'external' WHEN bindings = 1 THEN 'unique' ELSE 'several' END AS outcome FROM tr")
def _(spark, d):
    return syntax.traversed(small(spark))


@query("unique_bindings", f"""WITH {NODES}, {_BOUND}, rs AS (SELECT path, node, CASE WHEN bindings IS NULL THEN 'no binding' WHEN bindings > 1 THEN 'several bindings' WHEN distance > 8 THEN 'too far' WHEN shadowed > 0 THEN 'shadows another' ELSE '' END AS reason FROM tr)
SELECT path, node, reason = '' AS admitted, reason FROM rs""")
def _(spark, d):
    return syntax.unique_bindings(syntax.traversed(small(spark)))


_LABELS = """lb AS (SELECT n.path, n.scope, CASE WHEN p.kind IN ('Import', 'ImportFrom') THEN 'import' WHEN p.kind = 'ClassDef' THEN 'inherit' ELSE 'call' END AS kind, n.line,
  CASE WHEN p.kind = 'ImportFrom' THEN p.name || CASE WHEN p.name LIKE '%.' THEN '' ELSE '.' END || n.name ELSE n.name END AS imported, n.kind AS node_kind, p.kind AS over, n.field
  FROM nd n JOIN nd p ON p.path = n.path AND p.node = n.parent WHERE n.kind = 'alias' OR (p.kind = 'ClassDef' AND n.field = 'bases') OR (p.kind = 'Call' AND n.field = 'func'))"""


@query("import_labels", f"WITH {NODES}, {_LABELS} SELECT path, imported AS label, line FROM lb WHERE kind = 'import'")
def _(spark, d):
    return syntax.labels(small(spark)).where("kind = 'import'").select("path", "label", "line")


@query("inheritance_labels", f"WITH {NODES}, {_LABELS} SELECT lb.path, lb.scope, n.name AS label, lb.line FROM lb JOIN nd n ON n.path = lb.path AND n.line = lb.line AND n.field = 'bases' WHERE lb.kind = 'inherit'")
def _(spark, d):
    return syntax.labels(small(spark)).where("kind = 'inherit'").select("path", "scope", "label", "line")


_KEYS = f"""{NODES}, {_LABELS}, ps AS (SELECT DISTINCT path, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/') AS parts FROM nd),
ky AS (SELECT DISTINCT path AS target, array_to_string(parts[k:], '.') AS key FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS k FROM ps)),
im AS (SELECT DISTINCT path, imported AS label FROM lb WHERE kind = 'import'),
aq AS (SELECT DISTINCT path, label, unnest([ltrim(label, '.'), regexp_replace(ltrim(label, '.'), '\\.[^.]*$', '')]) AS key, unnest([0, 1]) AS way FROM im),
met AS (SELECT *, min(way) OVER (PARTITION BY path, label) AS best FROM aq JOIN ky USING (key) WHERE path <> target),
hit AS (SELECT path, label, min(target) AS target, count(DISTINCT target) AS n FROM met WHERE way = best GROUP BY ALL)"""


@query("import_resolution", f"WITH {_KEYS} SELECT path, label, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM im LEFT JOIN hit USING (path, label)")
def _(spark, d):
    return syntax.resolved_imports(small(spark))


@query("module_keys", f"WITH {_KEYS} SELECT target AS path, key FROM ky")
def _(spark, d):
    return syntax.module_keys(small(spark).select("path").distinct())


@query("inclusive_nodes", f"WITH {NODES} SELECT path, region, count(*) AS nodes FROM (SELECT path, unnest(regions) AS region FROM nd) GROUP BY ALL")
def _(spark, d):
    return syntax.tree_aggregate(small(spark), F.lit(1), F.count, "nodes")


@query("construct_policies", f"""WITH {NODES}, t AS {literal_sql(sorted(syntax.DECORATED.items()), 'decorator, policy')}, m AS (SELECT path, parent AS region, name AS decorator FROM nd WHERE field = 'decorator_list')
SELECT path, region, m.decorator, coalesce(policy, 'opaque') AS policy FROM m LEFT JOIN t USING (decorator)""")
def _(spark, d):
    return syntax.construct_policies(small(spark))


@query("region_owners", f"WITH {NODES}, m AS (SELECT path, parent AS region, min(line) AS first FROM nd WHERE field = 'decorator_list' GROUP BY ALL) SELECT n.path, n.node AS region, least(n.line, coalesce(first, n.line)) AS start_line, n.end_line FROM nd n LEFT JOIN m ON m.path = n.path AND m.region = n.node WHERE n.node = n.owner")
def _(spark, d):
    return syntax.region_owners(small(spark))


@query("call_and_base_resolution")
def _(spark, d):
    return resolution.references(_programs(spark, d))


@query("dependency_graph")
def _(spark, d):
    return resolution.dependency_graph(_programs(spark, d))


@query("subtree_fingerprints")
def _(spark, d):
    return syntax.fingerprints_of_files(_programs(spark, d))


@query("clone_repetition")
def _(spark, d):
    return syntax.clone_kinds_of_files(_programs(spark, d))


@query("callable_summaries")
def _(spark, d):
    return syntax.summaries(large(spark, d))


@query("system_dependences")
def _(spark, d):
    return resolution.system_edges(_programs(spark, d))


@query("parse_provenance")
def _(spark, d):
    return trees.provenance(_programs(spark, d).unionByName(corpus.files(spark)))


@query("node_reanchoring")
def _(spark, d):
    """The programs before and after each imports one more module in its first line."""
    before = _programs(spark, d)
    at = len("import os\n")
    both = before.withColumn("after", F.concat(F.lit("import os, re\n"), F.substring("text", at + 1, 1 << 30)))
    return syntax.reanchored_files(both, (at - 1, at - 1, len(", re")))


@query("import_layers")
def _(spark, d):
    """Layers of the import graph's condensation, over all programs: which files can be read before which. Files that import one
    another in a circle are one component, in one layer."""
    nodes, edges = resolution.import_graph(_programs(spark, d))
    edges = graphs.kept(edges)
    components = graphs.kept(graphs.strong_components(nodes, edges))
    placed = graphs.layers(components, graphs.condensation(edges, components))
    return components.join(placed, "component").select("node", "component", "cyclic", "layer")
