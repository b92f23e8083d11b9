"""Questions asked of syntax trees as rows: roles, complexity, labels, fingerprints, clones, scopes, the dependency graph.

``nodes`` is always the table of ``sources.trees``. A node's regions and scope are in its row, so none of this walks a tree:
ancestors are arrays, subtrees are equality on a region's number, and resolution is joins in the order of its ways.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import trees
from textloom.sources.shared import kept

# fixed values: what kinds of Python nodes contribute, and their canonical roles
BRANCHES = "If Elif For AsyncFor While ExceptHandler".split()
NESTING = "If For AsyncFor While Try TryStar".split()
FLOW_BREAKS = "Return Break Continue Raise".split()
REGION_CLASSES = {"Module": "file", "ClassDef": "declaration", "FunctionDef": "behavioral", "AsyncFunctionDef": "behavioral", "Lambda": "behavioral"}
ROLES = {
    "Module": ["Module"], "FunctionDef": ["Declaration", "Callable"], "AsyncFunctionDef": ["Declaration", "Callable"], "ClassDef": ["Declaration", "Type"], "Lambda": ["Callable"],
    "Import": ["Declaration", "Import"], "ImportFrom": ["Declaration", "Import"], "TypeAlias": ["Declaration", "Type"], "arguments": ["Parameter"], "arg": ["Parameter"],
    "Expr": ["Statement"], "Assert": ["Statement"], "Delete": ["Statement"], "Global": ["Statement"], "Nonlocal": ["Statement"], "Pass": ["Statement"], "Raise": ["Statement"],
    "Return": ["Statement"], "Break": ["Statement"], "Continue": ["Statement"], "If": ["Branch"], "Elif": ["Branch"], "Match": ["Branch", "Match"], "match_case": ["Case"],
    "For": ["Loop"], "AsyncFor": ["Loop"], "While": ["Loop"], "comprehension": ["Loop"], "Call": ["Expression", "Call"], "Assign": ["Expression", "Write"],
    "AugAssign": ["Expression", "Write"], "AnnAssign": ["Expression", "Write"], "NamedExpr": ["Expression", "Write"], "Name": ["Expression", "Read"], "Attribute": ["Expression", "Read"],
    "Constant": ["Expression", "Literal"], "List": ["Expression"], "Set": ["Expression"], "Tuple": ["Expression"], "Dict": ["Expression"],
    "ListComp": ["Expression"], "SetComp": ["Expression"], "DictComp": ["Expression"], "GeneratorExp": ["Expression"],
}


def adapter_facts(nodes: DataFrame) -> DataFrame:
    """path, node, region_class, branch, nesting, flow_break, tail: what each node tells metrics. A tail is the last
    statement of its list."""
    classes = F.create_map(*[F.lit(x) for kv in REGION_CLASSES.items() for x in kv])
    last = F.max("ordinal").over(Window.partitionBy("path", "parent", "field"))
    tail = F.col("field").isin("body", "orelse", "finalbody") & (F.col("ordinal") == last)
    return nodes.select("path", "node", classes[F.col("kind")].alias("region_class"), F.col("kind").isin(BRANCHES).cast("int").alias("branch"), F.col("kind").isin(NESTING).cast("int").alias("nesting"), F.col("kind").isin(FLOW_BREAKS).cast("int").alias("flow_break"), tail.alias("tail"))


def roles(nodes: DataFrame) -> DataFrame:
    """path, node, role: the canonical roles of each node, by a broadcast table of kinds."""
    table = nodes.sparkSession.createDataFrame([(k, r) for k, own in ROLES.items() for r in own], "kind string, role string")
    return nodes.select("path", "node", "kind").join(F.broadcast(table), "kind").select("path", "node", "role")


def regions(nodes: DataFrame) -> DataFrame:
    """path, region, kind, name, scope, role (file, behavioral, container, other), start_line, end_line, lines of each region."""
    role = F.when(F.col("kind") == "Module", "file").when(F.col("kind") == "ClassDef", "container").otherwise("behavioral")
    return nodes.where("node = owner").select("path", F.col("node").alias("region"), "kind", "name", "scope", role.alias("role"), F.col("line").alias("start_line"), "end_line", (F.col("end_line") - F.col("line") + 1).alias("lines"))


def _normalized(n: Column, total: Column, kinds: Column) -> Column:
    """Entropy over log2(kinds) from the sum of n log2 n; 0 of a single kind."""
    bits = F.log2(total) - n / total
    return F.round(F.when(kinds <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bits / F.log2(kinds)))), 6)


def complexity(nodes: DataFrame) -> DataFrame:
    """path, region, nodes, branches, cognitive, max_nesting, kind_entropy, edge_entropy: each node counts for its
    innermost region alone. Cognitive adds 1 + nesting for each branch and 1 for each break of the flow."""
    kind = F.col("kind")
    nesting = F.size(F.filter("above", lambda k: k.isin(NESTING)))
    branch, flow = kind.isin(BRANCHES).cast("long"), kind.isin(FLOW_BREAKS).cast("long")
    sums = nodes.groupBy("path", "owner").agg(F.count("*").alias("nodes"), F.sum(branch).alias("branches"), F.sum(branch * (1 + nesting) + flow).alias("cognitive"), F.max(nesting + kind.isin(NESTING).cast("int")).cast("long").alias("max_nesting"))
    for name, key in (("kind", kind), ("edge", F.when(F.size("above") > 0, F.concat_ws(">", F.element_at("above", -1), kind)))):
        counts = nodes.select("path", "owner", key.alias("k")).where("k IS NOT NULL").groupBy("path", "owner", "k").agg(F.count("*").alias("n"))
        one = counts.groupBy("path", "owner").agg(F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("n").alias("t"), F.count("*").alias("v"))
        sums = sums.join(one.select("path", "owner", _normalized(F.col("s"), F.col("t"), F.col("v")).alias(f"{name}_entropy")), ["path", "owner"], "left")
    return sums.select("path", F.col("owner").alias("region"), "nodes", "branches", "cognitive", "max_nesting", "kind_entropy", F.coalesce("edge_entropy", F.lit(0.0)).alias("edge_entropy"))


def labels(nodes: DataFrame) -> DataFrame:
    """path, scope, kind, label, line: imports, bases of classes and callees, as written."""
    parent = nodes.select("path", F.col("node").alias("parent"), F.col("kind").alias("over"), F.col("name").alias("module"))
    joined = nodes.where("kind = 'alias' OR field IN ('bases', 'func')").join(parent, ["path", "parent"])
    # an alias belongs to the region that it is in; a base to the class around
    module = F.when(F.col("over") == "ImportFrom", F.when(F.col("module").rlike(r"[^.]$"), F.concat("module", F.lit("."), "name")).otherwise(F.concat("module", "name"))).otherwise(F.col("name"))
    kind = F.when(F.col("over").isin("Import", "ImportFrom"), "import").when((F.col("over") == "ClassDef") & (F.col("field") == "bases"), "inherit").when((F.col("over") == "Call") & (F.col("field") == "func"), "call")
    return joined.select("path", "scope", kind.alias("kind"), F.when(kind == "import", module).otherwise(F.col("text")).alias("label"), "line").where("kind IS NOT NULL AND label IS NOT NULL")


def symbols(nodes: DataFrame) -> DataFrame:
    """path, symbol (path::scope), name, kind, outer (the scope around), scope of each named region."""
    found = nodes.where("kind IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')")
    outer = F.regexp_replace("scope", r"(^|\.)[^.]*$", "")
    return found.select("path", F.concat_ws("::", "path", "scope").alias("symbol"), "name", F.when(F.col("kind") == "ClassDef", "class").otherwise("function").alias("kind"), outer.alias("outer"), "scope")


def module_keys(paths: DataFrame) -> DataFrame:
    """path, key: the dotted names that a file may be imported by, from the whole path to its last part."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    parts = F.split(stem, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return paths.select("path", F.explode(keys).alias("key")).distinct()


def _outcome(found: DataFrame, keys: list[str]) -> DataFrame:
    """One target is resolved, several are ambiguous."""
    return found.groupBy(*keys).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).select(*keys, F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"))


def resolved_imports(nodes: DataFrame) -> DataFrame:
    """path, label, target (a path), outcome (resolved, ambiguous, external) of each import: the name that it has in full, or
    else without its last part, against module keys."""
    imports = labels(nodes).where("kind = 'import'").select("path", "label").distinct()
    keys = module_keys(nodes.select("path").distinct()).withColumnRenamed("path", "target")
    whole = F.ltrim("label", F.lit("."))
    asked = imports.select("path", "label", F.posexplode(F.array(whole, F.regexp_replace(whole, r"\.[^.]*$", ""))).alias("way", "key"))
    met = asked.join(keys, "key").where("path <> target")
    best = met.groupBy("path", "label").agg(F.min("way").alias("way"))
    found = _outcome(met.join(best, ["path", "label", "way"]), ["path", "label"])
    return imports.join(found, ["path", "label"], "left").select("path", "label", "target", F.coalesce("outcome", F.lit("external")).alias("outcome"))


def resolved_references(nodes: DataFrame) -> DataFrame:
    """path, scope, kind, label, target (a symbol), outcome, way of calls and bases. The ways, of which the first with a candidate
    decides: nearest scope around (types are not looked into), an enclosing type named by the qualifier or ``self``, a module named by
    it, a type anywhere named by it."""
    s = symbols(nodes)
    refs = labels(nodes).where("kind <> 'import'").select("path", "scope", "kind", "label").distinct().where(F.col("label").rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"))
    parts = F.split("label", r"\.")
    own = F.split(F.col("scope"), r"\.")
    around = F.transform(F.sequence(F.lit(0), F.when(F.col("scope") == "", 0).otherwise(F.size(own))), lambda k: F.array_join(F.slice(own, 1, k), "."))
    refs = refs.withColumn("simple", F.element_at(parts, -1)).withColumn("qualifier", F.when(F.size(parts) > 1, F.element_at(parts, -2))).withColumn("around", around)
    types = s.where("kind = 'class'").select("path", F.col("scope").alias("outer"), F.lit(True).alias("type"))
    inside = s.join(types, ["path", "outer"], "left").select("path", "outer", F.col("name").alias("simple"), F.col("symbol").alias("target"), F.coalesce("type", F.lit(False)).alias("type"))
    keys = ["path", "scope", "kind", "label"]
    walk = refs.select(*keys, "simple", "qualifier", F.posexplode("around").alias("depth", "outer"))
    hit = walk.join(inside, ["path", "outer", "simple"])
    near = hit.where("qualifier IS NULL AND NOT type").select(*keys, F.struct(F.lit(1).alias("way"), (-F.col("depth")).alias("far")).alias("rank"), "target")
    named = hit.where("type AND (qualifier IN ('self', 'cls') OR qualifier = element_at(split(outer, '[.]'), -1))").select(*keys, F.struct(F.lit(2).alias("way"), (-F.col("depth")).alias("far")).alias("rank"), "target")
    modules = module_keys(nodes.select("path").distinct()).select(F.col("path").alias("other"), F.col("key").alias("qualifier"))
    top = s.where("outer = ''").select(F.col("path").alias("other"), F.col("name").alias("simple"), F.col("symbol").alias("target"))
    by_module = refs.join(modules, "qualifier").join(top, ["other", "simple"]).select(*keys, F.struct(F.lit(3).alias("way"), F.lit(0).alias("far")).alias("rank"), "target")
    last = F.element_at(F.split("outer", r"\."), -1)
    of_type = inside.where("type").select(last.alias("qualifier"), "simple", "target")
    by_type = refs.join(of_type, ["qualifier", "simple"]).select(*keys, F.struct(F.lit(4).alias("way"), F.lit(0).alias("far")).alias("rank"), "target")
    every = near.unionByName(named).unionByName(by_module).unionByName(by_type)
    best = every.groupBy(*keys).agg(F.min("rank").alias("rank"))
    decided = every.join(best, [*keys, "rank"]).withColumn("way", F.col("rank.way"))
    found = _outcome(decided, [*keys, "way"])
    return refs.select(*keys).join(found, keys, "left").select(*keys, "target", F.coalesce("outcome", F.lit("external")).alias("outcome"), F.coalesce("way", F.lit(0)).alias("way"))


def dependency_graph(nodes: DataFrame) -> DataFrame:
    """a, b, kind, confidence: containment, imports, inheritance and calls. What is not found in the sources is a node of its own."""
    s = symbols(nodes)
    holds = s.select(F.when(F.col("outer") == "", F.col("path")).otherwise(F.concat_ws("::", "path", "outer")).alias("a"), F.col("symbol").alias("b"), F.lit("contains").alias("kind"), F.lit("resolved").alias("confidence"))
    external = lambda: F.concat(F.lit("external:"), F.col("label"))
    imports = resolved_imports(nodes).select(F.col("path").alias("a"), F.coalesce("target", external()).alias("b"), F.lit("import").alias("kind"), F.col("outcome").alias("confidence"))
    of = F.when(F.col("scope") == "", F.col("path")).otherwise(F.concat_ws("::", "path", "scope"))
    refs = resolved_references(nodes).select(of.alias("a"), F.coalesce("target", external()).alias("b"), "kind", F.col("outcome").alias("confidence"))
    return holds.unionByName(imports).unionByName(refs).distinct()


def fingerprints(nodes: DataFrame) -> DataFrame:
    """path, region, kind, nodes, exact, normal: digests of each named region's subtree, as written and with names replaced
    by the order in which they first occur. A node goes to each region around it, so a subtree is one group."""
    inside = nodes.select("path", F.explode("regions").alias("region"), "node", "kind", "field", "name", F.size("regions").alias("deep"), F.size("above").alias("low")).where("node >= region")
    tops = nodes.where("node = owner AND kind <> 'Module'").select("path", F.col("node").alias("region"), F.col("kind").alias("top"), F.size("regions").alias("from"))
    inside = inside.join(tops, ["path", "region"])
    first = inside.where("name IS NOT NULL AND kind <> 'Constant'").groupBy("path", "region", "name").agg(F.min("node").alias("first"))
    order = first.select("path", "region", "name", F.row_number().over(Window.partitionBy("path", "region").orderBy("first", "name")).alias("nth"))
    rows = inside.join(order, ["path", "region", "name"], "left")
    shape = F.concat_ws(":", (F.col("deep") - F.col("from")).cast("string"), F.col("low").cast("string"), "kind", "field")
    one = F.struct("node", F.concat_ws("=", shape, "name").alias("e"), F.concat_ws("=", shape, F.coalesce(F.when(F.col("kind") != "Constant", F.concat(F.lit("#"), F.col("nth").cast("string"))), F.col("name"))).alias("n"))
    g = rows.groupBy("path", "region", "top").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    digest = lambda c: F.sha2(F.array_join(F.col("xs").getField(c), "\n").cast("binary"), 256)
    return g.select("path", "region", F.col("top").alias("kind"), F.size("xs").cast("long").alias("nodes"), digest("e").alias("exact"), digest("n").alias("normal"))


#: What members of clones are, in order of their names.
_WHAT = ("declaration", "generated", "ordinary", "test")


def _region_ends(rows: list[tuple]) -> dict[int, int]:
    """For each region of a file's rows the number after its last node."""
    ends, open_ = {}, []
    for k, row in enumerate(rows):
        around = row[12]
        while open_ and (len(open_) > len(around) or open_[-1] != around[len(open_) - 1]):
            ends[open_.pop()] = k
        if around[-1] == k:
            open_.append(k)
    return ends | dict.fromkeys(open_, len(rows))


def _prints(rows: list[tuple]) -> Iterator[tuple]:
    """region, kind, nodes, exact, normal of each named region of a file's rows, as in ``fingerprints``."""
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode("utf-8", "surrogatepass")).hexdigest()
    parts = [(len(row[12]), f":{len(row[13])}:{row[4]}:{row[2]}", row[6], row[4] == "Constant") for row in rows]
    for region, end in sorted(_region_ends(rows).items()):
        if rows[region][4] == "Module":
            continue
        top, nth, exact, normal = parts[region][0], {}, [], []
        for deep, shape, name, constant in parts[region:end]:
            shape = f"{deep - top}{shape}"
            exact.append(shape if name is None else f"{shape}={name}")
            normal.append(exact[-1] if name is None or constant else f"{shape}=#{nth.setdefault(name, len(nth) + 1)}")
        yield region, rows[region][4], end - region, sha(exact), sha(normal)


def fingerprints_of_files(files: DataFrame) -> DataFrame:
    """What ``fingerprints`` gives of the nodes of files (path, lang, text), told where the texts are."""
    tell = lambda path, text: [(path, *x) for x in _prints(trees.tree(text or ""))]
    return trees.told(files, tell, "path string, region long, kind string, nodes long, exact string, normal string")


def clone_kinds(prints: DataFrame, regions: DataFrame, least: int = 8) -> DataFrame:
    """normal, members, form (exact, renamed), kinds, review: regions that are one another's copies, what their members are (tests,
    generated, containers, ordinary), and whether all are ordinary, so that one should look at them."""
    test = F.col("name").rlike("^test_") | F.col("path").rlike(r"(^|/)tests?/")
    role = F.when(F.col("path").rlike(r"(^|/)generated/|_pb2\.py$"), "generated").when(test, "test").when(F.col("role") == "container", "declaration").otherwise("ordinary")
    return _clones(prints.where(F.col("nodes") >= least).join(regions.select("path", "region", "name", "role"), ["path", "region"]).withColumn("what", role))


def clone_kinds_of_files(files: DataFrame, least: int = 8) -> DataFrame:
    """What ``clone_kinds`` gives of the regions of files (path, lang, text): digests leave a task once for each form, as
    those that are equal are counted there before they are shuffled."""

    def tell(path: str, text: str | None) -> Iterator[tuple]:
        rows = trees.tree(text or "")
        generated, tests = re.search(r"(^|/)generated/|_pb2\.py$", path), re.search(r"(^|/)tests?/", path)
        for region, kind, nodes, exact, normal in _prints(rows):
            if nodes >= least:
                test = tests or (rows[region][6] or "").startswith("test_")
                yield kind, normal, exact, "generated" if generated else "test" if test else "declaration" if kind == "ClassDef" else "ordinary"

    return _clones(trees.told(files, tell, "kind string, normal string, exact string, what string"))


def _clones(rows: DataFrame) -> DataFrame:
    """The classes of regions (kind, normal, exact, what) of more than one member."""
    flags = F.bit_or(sum(F.when(F.col("what") == w, 1 << k).otherwise(0) for k, w in enumerate(_WHAT)))
    g = rows.groupBy("kind", "normal").agg(F.count("*").alias("members"), (F.min("exact") == F.max("exact")).alias("one"), flags.alias("flags")).where("members > 1")
    kinds = F.concat_ws(",", *[F.when(F.col("flags").bitwiseAND(1 << k) != 0, w) for k, w in enumerate(_WHAT)])
    return g.select("kind", "normal", "members", F.when(F.col("one"), "exact").otherwise("renamed").alias("form"), kinds.alias("kinds"), (kinds == "ordinary").alias("review"))


def declarations(nodes: DataFrame) -> DataFrame:
    """path, scope_node, name, node, what: names that each scope binds (functions and classes in the scope around them)."""
    outside = F.element_at("regions", -2)
    what = F.when(F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef"), "definition").when(F.col("kind") == "arg", "parameter").when(F.col("kind") == "alias", "import").when(F.col("ctx") == "Store", "assignment")
    rows = nodes.where("size(regions) > 0 AND (kind IN ('arg', 'alias') OR (kind = 'Name' AND ctx = 'Store') OR (node = owner AND kind IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')))")
    return rows.select("path", F.when(F.col("node") == F.col("owner"), outside).otherwise(F.col("owner")).alias("scope_node"), F.when(F.col("kind") == "alias", F.regexp_replace("name", r"\..*$", "")).otherwise(F.col("name")).alias("name"), "node", what.alias("what"))


def traversed(nodes: DataFrame) -> DataFrame:
    """path, node, name, scope_node, distance, what, bindings, shadowed, outcome of each name that is read: the nearest scope around that
    binds it, classes passed over but for the innermost scope, how many bindings it has there, and how many scopes further out bind it
    too. Unique with one binding, several with more, external with none."""
    kinds = nodes.where("node = owner").select("path", F.col("node").alias("scope_node"), F.col("kind").alias("scope_kind"))
    reads = nodes.where("kind = 'Name' AND ctx = 'Load'").select("path", "node", "name", F.posexplode(F.reverse("regions")).alias("distance", "scope_node"))
    reads = reads.join(kinds, ["path", "scope_node"]).where("distance = 0 OR scope_kind <> 'ClassDef'")
    bound = declarations(nodes).groupBy("path", "scope_node", "name").agg(F.count("*").alias("bindings"), F.min(F.struct("node", "what")).alias("one"))
    met = reads.join(bound, ["path", "scope_node", "name"])
    best = met.groupBy("path", "node").agg(F.min(F.struct("distance", "scope_node", "bindings", F.col("one.what").alias("what"))).alias("x"), (F.count("*") - 1).alias("shadowed"))
    every = nodes.where("kind = 'Name' AND ctx = 'Load'").select("path", "node", "name")
    out = every.join(best, ["path", "node"], "left")
    outcome = F.when(F.col("x").isNull(), "external").when(F.col("x.bindings") == 1, "unique").otherwise("several")
    return out.select("path", "node", "name", "x.scope_node", "x.distance", "x.what", "x.bindings", F.coalesce("shadowed", F.lit(0)).alias("shadowed"), outcome.alias("outcome"))


def unique_bindings(found: DataFrame, most_distance: int = 8) -> DataFrame:
    """path, node, admitted, reason: the gate of what may be rewritten. One binding, in sight, that nothing shadows."""
    reason = F.when(F.col("outcome") == "external", "no binding").when(F.col("outcome") == "several", "several bindings").when(F.col("distance") > most_distance, "too far").when(F.col("shadowed") > 0, "shadows another")
    return found.select("path", "node", reason.isNull().alias("admitted"), F.coalesce(reason, F.lit("")).alias("reason"))


def reused(before: DataFrame, after: DataFrame, digests_before: DataFrame, digests_after: DataFrame) -> DataFrame:
    """path, state (reused, resolved again, gone): results of files whose text is the same are kept, all others are not."""
    d = digests_before.select("path", F.col("digest").alias("old")).join(digests_after.select("path", F.col("digest").alias("new")), "path", "full")
    state = F.when(F.col("new").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "reused").otherwise("resolved again")
    n = before.groupBy("path").agg(F.count("*").alias("had")).join(after.groupBy("path").agg(F.count("*").alias("has")), "path", "full")
    return d.join(n, "path", "left").select("path", state.alias("state"), F.coalesce("had", F.lit(0)).alias("had"), F.coalesce("has", F.lit(0)).alias("has"))


def summaries(nodes: DataFrame) -> DataFrame:
    """path, region, name, inputs (parameters in order), returns, globals (names read that the module or nothing binds)."""
    own = nodes.where("node = owner AND kind IN ('FunctionDef', 'AsyncFunctionDef')").select("path", F.col("node").alias("region"), "name")
    args = nodes.where("kind = 'arg'").groupBy("path", F.col("owner").alias("region")).agg(F.array_sort(F.collect_list(F.struct("node", "name"))).alias("a")).select("path", "region", F.col("a.name").alias("inputs"))
    returns = nodes.where("kind = 'Return'").groupBy("path", F.col("owner").alias("region")).agg(F.count("*").alias("returns"))
    owners = nodes.select("path", "node", F.col("owner").alias("region"))
    free = traversed(nodes).where("scope_node = 0 OR scope_node IS NULL").join(owners, ["path", "node"]).groupBy("path", "region").agg(F.array_sort(F.collect_set("name")).alias("globals"))
    joined = own.join(args, ["path", "region"], "left").join(returns, ["path", "region"], "left").join(free, ["path", "region"], "left")
    none = F.array().cast("array<string>")
    return joined.select("path", "region", "name", F.array_join(F.coalesce("inputs", none), ",").alias("inputs"), F.coalesce("returns", F.lit(0)).alias("returns"), F.array_join(F.coalesce("globals", none), ",").alias("globals"))


def system_edges(nodes: DataFrame) -> DataFrame:
    """path, call (node), kind, src, dst: call, parameter-in and return edges between call sites and the functions that they resolve to; a
    gap where one resolves to none. src and dst are ``path#node``."""
    at = lambda p, n: F.concat(F.col(p), F.lit("#"), F.col(n).cast("string"))
    calls = nodes.where("kind = 'Call'").select("path", F.col("node").alias("call"), "scope")
    func = nodes.where("field = 'func'").select("path", F.col("parent").alias("call"), F.col("text").alias("label"))
    calls = calls.join(func, ["path", "call"])
    refs = resolved_references(nodes).where("kind = 'call' AND target IS NOT NULL").select("path", "scope", "label", F.col("target").alias("symbol"))
    functions = nodes.where("node = owner AND kind IN ('FunctionDef', 'AsyncFunctionDef')").select(F.concat_ws("::", "path", "scope").alias("symbol"), F.col("path").alias("to"), F.col("node").alias("region"))
    # a symbol defined twice has its last definition
    functions = functions.groupBy("symbol", "to").agg(F.max("region").alias("region"))
    # resolved once and kept, as five sets of edges are made of it; what has no target is never joined by its null
    found = refs.join(functions, "symbol").drop("symbol")
    sites = kept(calls.join(found, ["path", "scope", "label"], "left"))
    gap = sites.where("region IS NULL").select("path", "call", F.lit("gap").alias("kind"), at("path", "call").alias("src"), F.lit(None).cast("string").alias("dst"))
    met = sites.where("region IS NOT NULL")
    call = met.select("path", "call", F.lit("call").alias("kind"), at("path", "call").alias("src"), at("to", "region").alias("dst"))
    given = nodes.where("field = 'args' AND kind <> 'arg'").select("path", F.col("parent").alias("call"), "ordinal", F.col("node").alias("value"))
    formals = nodes.where("kind = 'arg' AND field IN ('args', 'posonlyargs')").select(F.col("path").alias("to"), F.col("owner").alias("region"), F.col("node").alias("formal"), (F.row_number().over(Window.partitionBy("path", "owner").orderBy("node")) - 1).cast("long").alias("place"), F.col("name").alias("formal_name"))
    # a call through self or cls passes the object first
    shift = F.when(F.col("label").rlike(r"^(self|cls)\."), 1).otherwise(0)
    into = met.join(given, ["path", "call"]).withColumn("place", F.col("ordinal") + shift).join(formals, ["to", "region", "place"])
    into = into.select("path", "call", F.lit("parameter-in").alias("kind"), at("path", "value").alias("src"), at("to", "formal").alias("dst"))
    named = nodes.where("kind = 'keyword' AND name IS NOT NULL").select("path", F.col("parent").alias("call"), F.col("name").alias("formal_name"), F.col("node").alias("value"))
    by_name = met.join(named, ["path", "call"]).join(formals, ["to", "region", "formal_name"]).select("path", "call", F.lit("parameter-in").alias("kind"), at("path", "value").alias("src"), at("to", "formal").alias("dst"))
    back = nodes.where("kind = 'Return'").select(F.col("path").alias("to"), F.col("owner").alias("region"), F.col("node").alias("given"))
    out = met.join(back, ["to", "region"]).select("path", "call", F.lit("return").alias("kind"), at("to", "given").alias("src"), at("path", "call").alias("dst"))
    return call.unionByName(into).unionByName(by_name).unionByName(out).unionByName(gap)


def reanchored(before: DataFrame, after: DataFrame, edit: tuple[int, int, int]) -> DataFrame:
    """path, node, now, state of each old node after an edit (start, end, length of what replaced it): anchored again only where
    its range maps through the edit and kind, field, name and text are equal; else why it expired."""
    start, end, length = edit
    delta = length - (end - start)
    s, e = F.col("start"), F.col("end")
    moved = F.when(e <= start, 0).when(s >= end, delta)
    keys = ["path", "kind", "field", "name", "text", "start", "end"]
    old = before.select("path", "node", "kind", "field", "name", "text", (s + moved).alias("start"), (e + moved).alias("end"), moved.isNull().alias("touched"))
    new = after.select(F.col("node").alias("now"), *[F.col(c).alias(f"new_{c}") for c in keys])
    same = [F.col(c) == F.col(f"new_{c}") if c in ("path", "start", "end", "kind", "field") else F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in keys]
    joined = old.join(new, same, "left").groupBy("path", "node", "touched").agg(F.min("now").alias("now"))
    return joined.select("path", "node", "now", F.when(F.col("touched"), "edited").when(F.col("now").isNull(), "changed").otherwise("anchored").alias("state"))


def reanchored_files(files: DataFrame, edit: tuple[int, int, int]) -> DataFrame:
    """What ``reanchored`` gives of files (path, lang, text, after) that hold a text and what it is after the edit: both are
    parsed and compared in one task, so no node is shuffled."""
    start, end, length = edit
    delta = length - (end - start)

    def tell(path: str, text: str | None, after: str | None) -> Iterator[tuple]:
        found: dict[tuple, int] = {}
        for now, _, field, _, kind, _, name, s, e, *_, body in trees.tree(after or ""):
            found.setdefault((kind, field, name, body, s, e), now)
        for node, _, field, _, kind, _, name, s, e, *_, body in trees.tree(text or ""):
            moved = 0 if e <= start else delta if s >= end else None
            now = None if moved is None else found.get((kind, field, name, body, s + moved, e + moved))
            yield path, node, now, "edited" if moved is None else "changed" if now is None else "anchored"

    return trees.told(files, tell, "path string, node long, now long, state string", ("path", "text", "after"))


def tree_aggregate(nodes: DataFrame, value: Column, combine, name: str = "value") -> DataFrame:
    """path, region, ``name``: any aggregate (``combine`` of a column) over all nodes inside each region, nested regions included."""
    return nodes.select("path", F.explode("regions").alias("region"), value.alias("v")).groupBy("path", "region").agg(combine(F.col("v")).alias(name))


# fixed values: what decorators tell of the code that they are on
DECORATED = {"generated": "generated", "dataclass": "macro", "overload": "declaration only", "abstractmethod": "declaration only", "property": "accessor", "staticmethod": "plain", "classmethod": "plain"}


def construct_policies(nodes: DataFrame) -> DataFrame:
    """path, region, decorator, policy: how decorated regions are to be treated; unknown decorators make them opaque."""
    table = nodes.sparkSession.createDataFrame(sorted(DECORATED.items()), "decorator string, policy string")
    marks = nodes.where("field = 'decorator_list'").select("path", F.col("parent").alias("region"), F.regexp_extract(F.regexp_replace("text", r"\(.*$", ""), r"([A-Za-z_0-9]+)$", 1).alias("decorator"))
    return marks.join(F.broadcast(table), "decorator", "left").select("path", "region", "decorator", F.coalesce("policy", F.lit("opaque")).alias("policy"))


def region_owners(nodes: DataFrame) -> DataFrame:
    """path, region, start_line, end_line: regions with the lines of their decorators, which are theirs."""
    first = nodes.where("field = 'decorator_list'").groupBy("path", F.col("parent").alias("region")).agg(F.min("line").alias("first"))
    own = nodes.where("node = owner").select("path", F.col("node").alias("region"), "line", "end_line")
    return own.join(first, ["path", "region"], "left").select("path", "region", F.least("line", F.coalesce("first", "line")).alias("start_line"), "end_line")
