"""What is told where texts are, against the same asked of tree rows."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import resolution, syntax
from textloom.plans import catalogue
from textloom.sources import corpus, programs, trees

FOLDER = "/root/testdata/sf0.001"
ODD = [
    ("odd/a.py", "class A:\n    def f(self): return self.g(1)\n    def g(self, x, *, y=2): return A.f(self)\n    class B(A, helper(1)):\n        def f(self): return cls.f(), B.f(), A.g(x=1)\n"),
    ("odd/b.py", "from odd import a\nfrom .a import A, f as g\nimport a, os.path\ndef f(): pass\ndef f(x): return x\nclass f:\n    def g(self): return f(3), a.A(), A.f(4), b.f(5), self.h()\ng = lambda x: (lambda y: f(y))(x)\n"),
    ("odd/__init__.py", "def run(x, /, y):\n    if x:\n        return run(1, 2)\n    elif y:\n        return odd.run(1, y=2)\n    return é(x)\n"),
    ("odd/twice.py", "class A:\n    def f(self, z): return self.f(z=1)\n" * 2),
    ("odd/broken.py", "def f(:"), ("odd/empty.py", ""), ("odd/null.py", None),
]


def files(spark):
    odd = spark.createDataFrame([(p, "python", t) for p, t in ODD] + [("odd/x.rs", "rust", "fn f() {}")], programs.SCHEMA)
    return odd.unionByName(programs.programs(spark.range(90, 110), "id")).unionByName(corpus.modules(spark))


@pytest.fixture(scope="module")
def nodes(spark):
    return trees.nodes(files(spark).coalesce(4)).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_are_anchored_again_where_both_texts_are(spark):
    before = files(spark)
    first = F.concat(F.lit("import z\n"), "text")
    inside = F.concat(F.substring("text", 1, 6), F.lit("Z"), F.substring("text", 7, 1 << 30))
    for edit, new in (((0, 0, 9), first), ((6, 6, 1), inside)):
        after = before.withColumn("text", new)
        want = rows(syntax.reanchored(trees.nodes(before), trees.nodes(after), edit))
        assert rows(syntax.reanchored_files(before.withColumn("after", new), edit)) == want and {r[3] for r in want} >= {"anchored", "changed"}
    assert "Join" not in plan(spark, "node_reanchoring")


def test_regions_are_fingerprinted_where_their_texts_are(spark, nodes):
    want = rows(syntax.fingerprints(nodes))
    assert rows(syntax.fingerprints_of_files(files(spark))) == want and len({r[2] for r in want}) > 2
    clones = rows(syntax.clone_kinds(syntax.fingerprints(nodes), syntax.regions(nodes)))
    assert rows(syntax.clone_kinds_of_files(files(spark))) == clones and {r[3] for r in clones} == {"exact", "renamed"} and len({r[4] for r in clones}) > 2
    # a number that looks like a name is no name
    named = spark.createDataFrame([(f"{x}.py", "python", f"def f({x}):\n    return 1e999") for x in ("inf", "y")], programs.SCHEMA)
    for prints in (syntax.fingerprints_of_files(named), syntax.fingerprints(trees.nodes(named))):
        assert len({r.normal for r in prints.collect()}) == 1


def test_no_node_of_a_fingerprint_is_shuffled_or_written(spark):
    told = plan(spark, "subtree_fingerprints")
    assert "Join" not in told and "Relation" in told and told.count("Aggregate") == 1  # of the ids
    assert "Join" not in plan(spark, "clone_repetition")


@pytest.mark.parametrize("most", [resolution.MOST_BROADCAST, 3])
def test_references_are_resolved_as_those_of_nodes_are(spark, nodes, monkeypatch, most):
    monkeypatch.setattr(resolution, "MOST_BROADCAST", most)
    want = rows(syntax.resolved_references(nodes))
    assert rows(resolution.references(files(spark))) == want
    assert {(r[5], r[6]) for r in want} == {("resolved", 1), ("resolved", 2), ("resolved", 3), ("resolved", 4), ("ambiguous", 3), ("ambiguous", 4), ("external", 0)}


def test_imports_and_the_dependency_graph_are_those_of_nodes(spark, nodes):
    want = rows(syntax.resolved_imports(nodes))
    assert rows(resolution.imports(files(spark))) == want and {r[3] for r in want} == {"resolved", "ambiguous", "external"}
    assert rows(resolution.dependency_graph(files(spark))) == rows(syntax.dependency_graph(nodes))
    alone = programs.programs(spark.range(90, 99), "id")  # nothing is resolved across its files but imports
    assert rows(resolution.dependency_graph(alone)) == rows(syntax.dependency_graph(trees.nodes(alone)))


@pytest.mark.parametrize("most", [resolution.MOST_BROADCAST, 3])
def test_edges_of_systems_are_those_of_nodes(spark, nodes, monkeypatch, most):
    monkeypatch.setattr(resolution, "MOST_BROADCAST", most)
    want = rows(syntax.system_edges(nodes))
    assert rows(resolution.system_edges(files(spark))) == want and {r[2] for r in want} == {"gap", "call", "parameter-in", "return"}
    assert any(r[2] == "parameter-in" and r[3].split("#")[0] != r[4].split("#")[0] for r in want)


def test_what_a_file_settles_meets_no_other_file(spark):
    for name in ("call_and_base_resolution", "dependency_graph", "system_dependences"):
        told = plan(spark, name)
        assert "regions" not in told and "explode" not in told, name  # no nodes, no scopes around them as rows
