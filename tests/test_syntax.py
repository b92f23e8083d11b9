"""Questions asked of tree rows, against the standard library's trees walked directly."""

import ast
from collections import defaultdict

import pytest

from textloom.operators import syntax
from textloom.sources import corpus, programs, trees

IDS = range(60)


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([(programs.place(k), "python", programs.program(k)) for k in IDS], programs.SCHEMA).repartition(3)
    return trees.nodes(files).cache()


def sources():
    return {programs.place(k): programs.program(k) for k in IDS}


def functions(text):
    return [x for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]


def own(f):
    """Nodes of a function without those of regions inside."""
    out, stack = [], [c for c in ast.iter_child_nodes(f)]
    while stack:
        x = stack.pop()
        if not isinstance(x, trees.REGIONS):
            out.append(x)
            stack += ast.iter_child_nodes(x)
    return out


def canonical(node, rename):
    """A dump in source order, with names as written or by first occurrence."""
    seen, out = {}, []

    def walk(x, field):
        name = None if isinstance(x, ast.Module) else trees._name(x)
        if name is not None and rename and not isinstance(x, ast.Constant):
            name = f"#{seen.setdefault(name, len(seen))}"
        out.append((type(x).__name__, field, name))
        for f, v in ast.iter_fields(x):
            for c in v if isinstance(v, list) else [v]:
                if isinstance(c, ast.AST) and not isinstance(c, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
                    out.append("(")
                    walk(c, f)
                    out.append(")")

    walk(node, "")
    return str(out[0][0]) + str(out[0][2:]) + str(out[1:])


def test_fingerprints_part_regions_as_trees_do(nodes):
    got = {(r.path, r.region): (r.exact, r.normal, r.nodes) for r in syntax.fingerprints(nodes).collect()}
    place = {(r.path, r.line, r.scope): r.node for r in nodes.where("node = owner AND kind <> 'Module'").collect()}
    want, classes = {}, [defaultdict(set), defaultdict(set)]
    for path, text in sources().items():
        for x in ast.walk(ast.parse(text)):
            if isinstance(x, trees.REGIONS) and not isinstance(x, ast.Module):
                want[path, x.lineno, x.col_offset] = [canonical(x, r) for r in (False, True)]
    by_place = {(r.path, r.line, r.start): r.node for r in nodes.where("node = owner AND kind <> 'Module'").collect()}
    assert len(by_place) == len(want) == len(got) == len(place)
    line_starts = {p: [0, *(sum(len(x) + 1 for x in t.split("\n")[: k + 1]) for k in range(t.count("\n")))] for p, t in sources().items()}
    for (path, line, col), forms in want.items():
        region = by_place[path, line, line_starts[path][line - 1] + col]
        for k in (0, 1):
            classes[k][forms[k]].add(got[path, region][k])
    for k in (0, 1):
        assert all(len(x) == 1 for x in classes[k].values())  # equal trees, equal digests
        assert len({next(iter(x)) for x in classes[k].values()}) == len(classes[k])  # and different ones differ


def test_copies_are_clones(nodes):
    out = syntax.clone_kinds(syntax.fingerprints(nodes), syntax.regions(nodes)).collect()
    tally = [r for r in out if r.members == sum(k % 4 < 2 for k in IDS)]
    assert len(tally) == 1 and tally[0].form == "renamed" and tally[0].kinds == "ordinary" and tally[0].review
    tests = [r for r in out if r.kinds == "test"]
    assert tests and not any(r.review for r in tests)


def test_summaries(nodes):
    got = defaultdict(list)
    for r in syntax.summaries(nodes).collect():
        got[r.path].append((r.name, r.inputs, r.returns))
    for path, text in sources().items():
        want = sorted((f.name, ",".join(a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]), sum(isinstance(x, ast.Return) for x in own(f))) for f in functions(text))
        assert sorted(got[path]) == want


def test_complexity(nodes):
    got = defaultdict(list)
    names = {(r.path, r.region): r.name for r in syntax.regions(nodes).where("kind = 'FunctionDef'").collect()}
    for r in syntax.complexity(nodes).collect():
        if (r.path, r.region) in names:
            got[r.path].append((names[r.path, r.region], r.branches, r.cognitive))

    def walk(x, deep, found):
        for c in ast.iter_child_nodes(x):
            if isinstance(c, trees.REGIONS):
                continue
            is_elif = isinstance(x, ast.If) and isinstance(c, ast.If) and c in x.orelse and len(x.orelse) == 1 and c.col_offset == x.col_offset
            branch = isinstance(c, (ast.If, ast.For, ast.While, ast.ExceptHandler))
            found[0] += branch
            found[1] += branch * (1 + deep) + isinstance(c, (ast.Return, ast.Break, ast.Continue, ast.Raise))
            walk(c, deep + (isinstance(c, (ast.If, ast.For, ast.While, ast.Try)) and not is_elif), found)

    for path, text in sources().items():
        want = []
        for f in functions(text):
            found = [0, 0]
            walk(f, 0, found)
            want.append((f.name, *found))
        assert sorted(got[path]) == sorted(want)


def test_graph_and_ways(spark):
    n = trees.nodes(corpus.modules(spark)).cache()
    imports = {(r.path, r.label): (r.target, r.outcome) for r in syntax.resolved_imports(n).collect()}
    assert imports["tools/use.py", "rates"] == (None, "ambiguous") and imports["shop/cart.py", "shop.base.Item"] == ("shop/base.py", "resolved")
    assert imports["shop/cart.py", "shop.rates"] == ("shop/rates.py", "resolved") and imports["shop/base.py", "os"] == (None, "external")
    refs = {(r.path, r.scope, r.label): (r.target, r.way) for r in syntax.resolved_references(n).collect()}
    assert refs["shop/base.py", "Item.price", "self.round"] == ("shop/base.py::Item.round", 2)
    assert refs["shop/rates.py", "rate", "inner"] == ("shop/rates.py::rate.inner", 1)
    assert refs["shop/cart.py", "Cart.total", "Item.round"] == ("shop/base.py::Item.round", 4)
    assert refs["shop/base.py", "Item.round", "int"] == (None, 0)
    assert refs["shop/cart.py", "Cart", "Item"] == (None, 0)  # another file's type by its bare name is not in scope
    edges = {(r.a, r.b, r.kind) for r in syntax.dependency_graph(n).collect()}
    assert ("shop/base.py::Item", "shop/base.py::Item.price", "contains") in edges and ("shop/base.py::Item.price", "shop/base.py::Item.round", "call") in edges
    assert ("shop/cart.py::Cart", "external:Item", "inherit") in edges
    s = syntax.system_edges(n).where("path = 'shop/base.py'").collect()
    call = next(r for r in s if r.kind == "call")
    name = {f"{r.path}#{r.node}": r.name for r in n.collect()}
    assert name[call.dst] == "round" and [(name[r.src], name[r.dst]) for r in s if r.kind == "parameter-in"] == [("n", "n")] and sum(r.kind == "return" for r in s) == 1


def test_provenance_and_reanchoring(spark):
    ids = spark.range(90, 100)
    status = {r.path: r.status for r in trees.provenance(programs.programs(ids, "id")).collect()}
    assert {p for p, s in status.items() if s == "partial"} == {programs.place(96)} and len(status) == 10
    before = spark.createDataFrame([("a.py", "python", "x = 1\ny = x + 2\n")], programs.SCHEMA)
    after = spark.createDataFrame([("a.py", "python", "x = 10\ny = x + 2\n")], programs.SCHEMA)
    out = {r.node: r.state for r in syntax.reanchored(trees.nodes(before), trees.nodes(after), (5, 5, 1)).collect()}
    kinds = {r.node: (r.kind, r.start) for r in trees.nodes(before).collect()}
    assert {kinds[k]: s for k, s in out.items()}["Name", 6] == "anchored" and {kinds[k]: s for k, s in out.items()}["Constant", 4] == "changed"
    assert trees.nodes(before.limit(0)).count() == 0


def test_reused(spark):
    d = lambda *x: spark.createDataFrame(list(x), "path string, digest string")
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "path string")
    out = {r.path: (r.state, r.had, r.has) for r in syntax.reused(rows, rows.where("path <> 'c'"), d(("a", "1"), ("b", "1"), ("c", "1")), d(("a", "1"), ("b", "2"))).collect()}
    assert out == {"a": ("reused", 2, 2), "b": ("resolved again", 1, 1), "c": ("gone", 1, 0)}
