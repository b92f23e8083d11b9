"""References, imports and the edges of systems, resolved from what each file tells of itself.

The same as ``syntax.resolved_references``, ``resolved_imports``, ``dependency_graph`` and ``system_edges`` give of nodes, of files (path,
lang, text; each path once). Scopes around a name are in its own file, so nearest scopes and enclosing types are settled in the task
that parses it. Other files matter only through what a qualifier names, so distinct pairs of qualifier and name meet the definitions,
which are summed up for each pair first: no frequent name makes pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources import trees
from textloom.sources.shared import kept

#: Up to so many pairs of qualifier and name are broadcast.
MOST_BROADCAST = 100_000
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
#: Edges that no other file gives too.
_SETTLED = "kind = 'contains' OR confidence <> 'resolved'"
_FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")


def module_keys(path: str) -> list[str]:
    """The dotted names that a file may be imported by, as in ``syntax.module_keys``."""
    parts = re.sub(r"/__init__\Z", "", re.sub(r"\.py\Z", "", path)).split("/")
    return list(dict.fromkeys(".".join(parts[k:]) for k in range(len(parts))))


class Outline:
    """What a file's rows tell of its names."""

    def __init__(self, path: str, rows: list[tuple]):
        self.path, self.rows = path, rows
        #: names by the scope around them, each with the scope of its own, and the scopes of classes
        self.symbols: dict[tuple[str, str], str] = {}
        self.classes: set[str] = set()
        for row in rows:
            if row[4] == "ClassDef" or row[4] in _FUNCTIONS:
                scope = row[14]
                self.symbols[scope.rpartition(".")[0], row[6]] = scope
                if row[4] == "ClassDef":
                    self.classes.add(scope)

    def symbol(self, scope: str) -> str:
        return f"{self.path}::{scope}"

    def at(self, scope: str) -> str:
        return self.symbol(scope) if scope else self.path

    def near(self, scope: str, label: str) -> tuple[str | None, int | None, str | None, str]:
        """Target's scope, way, qualifier and simple name of a reference. The way is 1 or 2 where this file settles it, 0 where no file
        can, and None where others may."""
        head, _, simple = label.rpartition(".")
        qualifier = head.rpartition(".")[2] if head or "." in label else None
        outer = scope
        while True:
            if (outer, simple) in self.symbols:
                if qualifier is None:
                    if outer not in self.classes:
                        return self.symbols[outer, simple], 1, None, simple
                elif outer in self.classes and (qualifier in ("self", "cls") or qualifier == outer.rpartition(".")[2]):
                    return self.symbols[outer, simple], 2, qualifier, simple
            if not outer:
                return None, 0 if qualifier is None else None, qualifier, simple
            outer = outer.rpartition(".")[0]

    def references(self) -> Iterator[tuple]:
        """scope, kind, label, target's scope, way, qualifier, simple name of each distinct call and base."""
        seen = set()
        for row in self.rows:
            if row[2] not in ("func", "bases") or row[15] is None:
                continue
            key = row[14], "call" if row[2] == "func" else "inherit", row[15]
            if key not in seen and _PLAIN.fullmatch(row[15]):
                seen.add(key)
                yield *key, *self.near(row[14], row[15])

    def definitions(self) -> Iterator[tuple[int, str, str, str]]:
        """way, qualifier, simple name and scope of what other files may mean: what is defined at the top by the module's last name (a
        qualifier has no dots), what is inside types by theirs."""
        module = module_keys(self.path)[-1]
        for (outer, simple), scope in self.symbols.items():
            if not outer and "." not in module:
                yield 3, module, simple, scope
            if outer in self.classes:
                yield 4, outer.rpartition(".")[2], simple, scope

    def imports(self) -> list[str]:
        """The distinct labels of imports, as in ``syntax.labels``."""
        found = {}
        for row in self.rows:
            if row[4] == "alias":
                over, name = self.rows[row[1]], row[6]
                if over[4] == "ImportFrom":
                    name = f"{over[6]}{'' if over[6].endswith('.') or not over[6] else '.'}{name}"
                found[name] = None
        return list(found)

    def contained(self) -> dict[tuple[str, str], None]:
        return {(self.at(outer), self.symbol(scope)): None for (outer, _), scope in self.symbols.items()}


def _meanings(asked: DataFrame, defs: DataFrame) -> tuple[DataFrame, bool]:
    """qualifier, simple, target, outcome, way of the pairs (qualifier, simple) of ``asked`` that ``defs`` (way, qualifier, simple,
    target) give a meaning: the lowest way decides; one target is resolved, several are ambiguous. And whether they are few."""
    pair = ["qualifier", "simple"]
    asked = kept(asked.select(*pair).distinct())
    few = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if few:
        defs = defs.join(F.broadcast(asked), pair, "left_semi")
    of = lambda f, way: f(F.when(F.col("way") == way, F.col("target"))).alias(f"{f.__name__}{way}")
    sums = defs.groupBy(*pair).agg(*[of(f, way) for way in (3, 4) for f in (F.min, F.max)])
    if not few:
        sums = sums.join(asked, pair, "left_semi")
    low, high = F.coalesce("min3", "min4"), F.coalesce("max3", "max4")
    one = low == high
    way = F.when(F.col("min3").isNotNull(), 3).otherwise(4)
    return kept(sums.select(*pair, F.when(one, low).alias("target"), F.when(one, "resolved").otherwise("ambiguous").alias("outcome"), way.alias("way"))), few


def _met(open_: DataFrame, found: DataFrame, few: bool, how: str = "left") -> DataFrame:
    return open_.join(F.broadcast(found) if few else found, ["qualifier", "simple"], how)


def _defs(told: DataFrame) -> DataFrame:
    return told.where("what = 'def'").select("qualifier", "simple", "target", "way")


def references(files: DataFrame) -> DataFrame:
    """path, scope, kind, label, target (a symbol), outcome, way of calls and bases."""

    def tell(path: str, text: str | None) -> Iterator[tuple]:
        o = Outline(path, trees.tree(text or ""))
        for scope, kind, label, target, way, qualifier, simple in o.references():
            open_ = way is None
            yield "ref", path, scope, kind, label, o.symbol(target) if target else None, way, qualifier if open_ else None, simple if open_ else None
        for way, qualifier, simple, scope in o.definitions():
            yield "def", None, None, None, None, o.symbol(scope), way, qualifier, simple

    told = kept(trees.told(files, tell, "what string, path string, scope string, kind string, label string, target string, way int, qualifier string, simple string"))
    keys = ["path", "scope", "kind", "label"]
    done = told.where("what = 'ref' AND way IS NOT NULL").select(*keys, "target", F.when(F.col("way") > 0, "resolved").otherwise("external").alias("outcome"), "way")
    open_ = told.where("what = 'ref' AND way IS NULL").select(*keys, "qualifier", "simple")
    met = _met(open_, *_meanings(open_, _defs(told)))
    return done.unionByName(met.select(*keys, "target", F.coalesce("outcome", F.lit("external")).alias("outcome"), F.coalesce("way", F.lit(0)).alias("way")))


_IMPORTS = "what string, path string, label string, whole string, own_whole int, part string, own_part int"


def _told_imports(o: Outline) -> Iterator[tuple]:
    """Rows of ``_IMPORTS``: what a file imports, by the name in full and without its last part, and whether it has that name
    itself; and the names that it may be imported by."""
    if not o.rows:
        return
    own = module_keys(o.path)
    for label in o.imports():
        whole = label.lstrip(".")
        part = whole.rpartition(".")[0] if "." in whole else None
        yield "import", o.path, label, whole, int(whole in own), part, int(part in own)
    for key in own:
        yield "module", o.path, None, key, None, None, None


def _resolved_imports(told: DataFrame) -> DataFrame:
    """path, label, target, outcome from rows of ``_IMPORTS``: other files with a name are its files but for the importing one, which
    knows whether it has it, so a name's number of files and the first and last of them are enough."""
    names = told.where("what = 'module'").groupBy(F.col("whole").alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
    asked = told.where("what = 'import'").drop("what")
    first = names.toDF("whole", "n0", "low0", "high0")
    others = lambda n, own: F.coalesce(F.col(n), F.lit(0)) - F.col(own)
    asked = asked.join(first, "whole", "left").withColumn("k0", others("n0", "own_whole"))
    # what is settled by its whole name, or has no other, asks for nothing: each under a key of its own
    asked = asked.withColumn("asks", F.when((F.col("k0") > 0) | F.col("part").isNull(), F.concat(F.lit("\n"), "path")).otherwise(F.col("part")))
    asked = asked.join(names.toDF("asks", "n1", "low1", "high1"), "asks", "left").withColumn("k1", others("n1", "own_part"))
    by = lambda k: F.when(F.col(f"k{k}") == 1, F.when(F.col(f"low{k}") == F.col("path"), F.col(f"high{k}")).otherwise(F.col(f"low{k}")))
    k = F.when(F.col("k0") > 0, F.col("k0")).otherwise(F.col("k1"))
    outcome = F.when(k == 1, "resolved").when(k > 1, "ambiguous").otherwise("external")
    return asked.select("path", "label", F.when(F.col("k0") > 0, by(0)).otherwise(by(1)).alias("target"), outcome.alias("outcome"))


def _imports_of(files: DataFrame) -> DataFrame:
    return kept(trees.told(files, lambda path, text: _told_imports(Outline(path, trees.tree(text or ""))), _IMPORTS))


def imports(files: DataFrame) -> DataFrame:
    """path, label, target (a path), outcome of each import."""
    return _resolved_imports(_imports_of(files))


def import_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that parse (node), and which of them imports which (a, b)."""
    told = _imports_of(files)
    edges = _resolved_imports(told).where("outcome = 'resolved'").select(F.col("path").alias("a"), F.col("target").alias("b")).distinct()
    return told.where("what = 'module'").select(F.col("path").alias("node")).distinct(), edges


def dependency_graph(files: DataFrame) -> DataFrame:
    """a, b, kind, confidence: containment, imports, inheritance and calls."""

    def tell(path: str, text: str | None) -> Iterator[tuple]:
        o = Outline(path, trees.tree(text or ""))
        edges = {(a, b, "contains", "resolved") for a, b in o.contained()}
        for scope, kind, label, target, way, qualifier, simple in o.references():
            if way is None:
                yield "ref", o.at(scope), None, kind, None, label, qualifier, simple
            else:
                edges.add((o.at(scope), o.symbol(target) if way else f"external:{label}", kind, "resolved" if way else "external"))
        for edge in edges:
            yield "edge", *edge
        for way, qualifier, simple, scope in o.definitions():
            yield "def", None, None, None, None, None, qualifier, simple, o.symbol(scope), way
        for what, own, label, whole, own_whole, part, own_part in _told_imports(o):
            yield what, None, None, None, None, label, None, None, None, None, own, whole, own_whole, part, own_part

    schema = "what string, a string, b string, kind string, confidence string, label string, qualifier string, simple string, target string, way int, path string, whole string, own_whole int, part string, own_part int"
    rest = [(None,) * k for k in range(16)]
    told = kept(trees.told(files, lambda *x: (row + rest[15 - len(row)] for row in tell(*x)), schema))
    out = ["a", "b", "kind", "confidence"]
    known = lambda df: df.select("a", F.coalesce("target", F.concat(F.lit("external:"), F.col("label"))).alias("b"), "kind", F.coalesce("outcome", F.lit("external")).alias("confidence"))
    edges = told.where("what = 'edge'").select(*out)
    open_ = told.where("what = 'ref'").select("a", "kind", "label", "qualifier", "simple")
    found, few = _meanings(open_, _defs(told))
    refs = known(_met(open_, found, few))
    into = known(_resolved_imports(told.select(*_IMPORTS.replace(" string", "").replace(" int", "").split(", "))).withColumn("a", F.col("path")).withColumn("kind", F.lit("import")))
    # only labels that mean the same in the end give an edge twice, and of those that a file settles it has told each once
    parts = [into] if found.isEmpty() else [into, refs, edges.where(f"NOT ({_SETTLED})")]
    once = edges.unionByName(refs) if len(parts) == 1 else edges.where(_SETTLED)
    every = reduce(DataFrame.unionByName, parts)
    return once.unionByName(every.where("confidence <> 'resolved'")).unionByName(every.where("confidence = 'resolved'").distinct())


def system_edges(files: DataFrame) -> DataFrame:
    """path, call (node), kind, src, dst: call, parameter-in and return edges between call sites and the functions that they resolve
    to; a gap where one resolves to none. Calls within a file are settled where it is parsed; others go out with the nodes of their
    arguments, and definitions with those of their parameters and returns."""

    def tell(path: str, text: str | None) -> Iterator[tuple]:
        rows = trees.tree(text or "")
        o, none = Outline(path, rows), (None,) * 8
        functions: dict[str, int] = {}  # a symbol defined twice has its last definition
        formals: dict[int, list[tuple]] = {}
        returns: dict[int, list[int]] = {}
        calls: dict[int, list] = {}
        for row in rows:
            node, parent, field, _, kind, owner = *row[:5], row[11]
            if kind == "Call":
                calls[node] = [row[14], None, [], []]
            elif kind in _FUNCTIONS:
                functions[row[14]] = node
            elif kind == "Return":
                returns.setdefault(owner, []).append(node)
            elif kind == "arg" and field in ("args", "posonlyargs"):
                formals.setdefault(owner, []).append((node, row[6]))
            if parent in calls:
                if field == "func":
                    calls[parent][1] = row[15]
                elif field == "args":
                    calls[parent][2].append(node)
                elif kind == "keyword" and row[6] is not None:
                    calls[parent][3].append((row[6], node))
        ways: dict[tuple, tuple] = {}
        for call, (scope, label, given, named) in calls.items():
            src, region, open_ = f"{path}#{call}", None, None
            if label is not None and _PLAIN.fullmatch(label):
                if (scope, label) not in ways:
                    ways[scope, label] = o.near(scope, label)
                target, way, qualifier, simple = ways[scope, label]
                region = functions.get(target) if way else None
                open_ = (qualifier, simple) if way is None else None
            shift = int(label is not None and label.startswith(("self.", "cls.")))
            if open_:
                yield "site", path, call, None, None, None, *open_, None, None, shift, given, [x[0] for x in named], [x[1] for x in named]
            elif region is None:
                yield "edge", path, call, "gap", src, None, *none
            else:
                into = formals.get(region, ())
                yield "edge", path, call, "call", src, f"{path}#{region}", *none
                for place, value in enumerate(given, shift):
                    if place < len(into):
                        yield "edge", path, call, "parameter-in", f"{path}#{value}", f"{path}#{into[place][0]}", *none
                for name, value in named:
                    for formal, other in into:
                        if other == name:
                            yield "edge", path, call, "parameter-in", f"{path}#{value}", f"{path}#{formal}", *none
                for given_back in returns.get(region, ()):
                    yield "edge", path, call, "return", f"{path}#{given_back}", src, *none
        for way, qualifier, simple, scope in o.definitions():
            region = functions.get(scope)
            into = formals.get(region, ())
            yield "def", path, region, None, None, None, qualifier, simple, o.symbol(scope), way, None, [x[0] for x in into], [x[1] for x in into], returns.get(region, [])

    schema = "what string, path string, call long, kind string, src string, dst string, qualifier string, simple string, target string, way int, shift int, given array<long>, names array<string>, nodes array<long>"
    told = kept(trees.told(files, tell, schema))
    out = ["path", "call", "kind", "src", "dst"]
    edges = told.where("what = 'edge'").select(*out)
    sites = told.where("what = 'site'").select("path", "call", "qualifier", "simple", "shift", "given", "names", "nodes")
    found, few = _meanings(sites, _defs(told))
    # an edge goes to functions alone; a definition's given are its parameters, its nodes its returns
    own = told.where("what = 'def' AND call IS NOT NULL").select("qualifier", "simple", "target", "way", F.col("path").alias("to"), F.col("call").alias("region"), F.col("given").alias("formals"), F.col("names").alias("formal_names"), F.col("nodes").alias("returns"))
    resolved = found.where("target IS NOT NULL").drop("outcome")
    functions = kept(own.join(F.broadcast(resolved) if few else resolved, ["qualifier", "simple", "target", "way"], "left_semi").drop("target", "way"))
    met = _met(sites, functions, few)
    at, src = lambda p, n: F.concat(F.col(p), F.lit("#"), n.cast("string")), F.concat(F.col("path"), F.lit("#"), F.col("call").cast("string"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst"))
    formal = lambda k: F.get(F.col("formals"), k)
    into = F.transform("given", lambda x, k: edge("parameter-in", at("path", x), at("to", formal(k + F.col("shift")))))
    by_name = F.transform("nodes", lambda x, k: edge("parameter-in", at("path", x), at("to", formal(F.array_position("formal_names", F.get(F.col("names"), k)).cast("int") - 1))))
    passed = F.filter(F.concat(into, by_name), lambda e: e.dst.isNotNull())
    back = F.transform("returns", lambda x: edge("return", at("to", x), src))
    call = F.array(edge("call", src, at("to", F.col("region"))))
    gap = F.array(edge("gap", src, F.lit(None).cast("string")))
    across = met.select("path", "call", F.inline(F.when(F.col("region").isNull(), gap).otherwise(F.concat(call, passed, back))))
    return edges.unionByName(across.select(*out))
