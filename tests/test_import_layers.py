"""Layers of imports over long chains, and what the query gives."""

import random
import re

from textloom.operators import graphs
from textloom.plans import catalogue
from textloom.sources import programs


def layers_of(nodes, edges):
    after = dict.fromkeys(nodes, ())
    for a, b in edges:
        after[a] = (*after[a], b)
    out = {}
    for n in sorted(nodes):  # edges go to smaller nodes
        out[n] = max((out[b] + 1 for b in after[n]), default=0)
    return out


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 120 nodes with side branches and shortcuts, ways of several lengths between two nodes, and circles beside it."""
    monkeypatch.setattr(graphs, "SMALL", 0)
    draw = random.Random(7)
    edges = {(k, k - 1) for k in range(1, 120)} | {(k, draw.randrange(k)) for k in range(120, 230)} | {(200, 5), (230, 0), (230, 119), (231, 230), (231, 3)}
    nodes = range(240)
    written = []
    monkeypatch.setattr(graphs, "kept", lambda df, f=graphs.kept: written.append(1) or f(df))
    e = spark.createDataFrame(sorted(edges), "from_ long, to_ long")
    got = {r.component: r.layer for r in graphs.layers(spark.range(240).toDF("component"), e).collect()}
    assert got == layers_of(nodes, edges) and max(got.values()) > 120 and len(written) < 40
    written.clear()
    rings = [(300 + k, 300 + (k + 1) % 3) for k in range(3)] + [(310, 311), (311, 310), (311, 300), (302, 9), (312, 310)]
    both = spark.createDataFrame(sorted(edges) + rings, "a long, b long")
    found = {r.node: (r.component, r.cyclic) for r in graphs.strong_components(spark.range(320).toDF("node"), both).collect()}
    assert found == {n: (300, True) if 300 <= n < 303 else (310, True) if n in (310, 311) else (n, False) for n in range(320)} and len(written) < 80


def test_import_layers_are_layers(spark):
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    parses = {k for k in ids if k % 97 != 96}
    edges = {(k, int(re.search(r"import Base(\d+)", programs.program(k))[1])) for k in parses}
    want = layers_of(parses, {(a, b) for a, b in edges if a != b and b in parses})
    got = {r.node: (r.component, r.cyclic, r.layer) for r in catalogue.QUERIES["import_layers"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {programs.place(k): (programs.place(k), False, n) for k, n in want.items()} and max(want.values()) > 9
