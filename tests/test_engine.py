"""The engine's queries against DuckDB, and its kernels against plain Python."""

import math
import random

import pytest

from textloom.functions import text as X
from textloom.operators import flow, rules
from textloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.5g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    return str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def random_graph(seed, n=9, m=16):
    draw = random.Random(seed)
    after = {}
    for _ in range(m):
        after.setdefault(draw.randrange(n), []).append(draw.randrange(n))
    return after


@pytest.mark.parametrize("seed", range(40))
def test_dominators_by_leaving_points_out(seed):
    after = random_graph(seed)
    dom = flow.dominators(0, after)
    reached = flow.reach(0, after)
    for x in reached:
        without = {a: [b for b in many if b != x] for a, many in after.items() if a != x}
        still = flow.reach(0, without) if x else set()
        for p in reached:
            assert (x in dom[p]) == (p == x or p not in still)
    for p, up in flow.immediate(dom).items():
        assert up is None if p == 0 else dom[up] == dom[p] - {p}


@pytest.mark.parametrize("seed", range(20))
def test_reaching_definitions_and_liveness_by_paths(seed):
    draw = random.Random(seed + 100)
    after = random_graph(seed + 100, 7, 10)
    points = sorted(flow.reach(0, after))
    defs = {p: [(p, draw.choice("xy"))] for p in points if draw.random() < 0.5}
    uses = {p: {draw.choice("xy")} for p in points if draw.random() < 0.5}
    into = flow.reaching(after, 0, defs)
    alive = flow.live(after, points, {p: {n for _, n in d} for p, d in defs.items()}, uses)
    for name in "xy":
        kills = {p for p in points if any(n == name for _, n in defs.get(p, ()))}
        for q in kills:
            seen = set()
            for b in after.get(q, ()):
                seen |= {b} | ({x for x in flow.reach(b, {a: m for a, m in after.items() if a not in kills})} if b not in kills else set())
            assert {p for p in points if (q, name) in into[p]} == seen & set(points)
        for p in points:
            onward = flow.reach(p, {a: m for a, m in after.items() if a not in kills}) if p not in kills else {p}
            assert (name in alive[p]) == any(name in uses.get(x, ()) for x in onward)


SOURCE = """
def f(a, n):
    total = 0
    for i in range(n):
        if i == a:
            break
        elif i > 9:
            continue
        total += i
    else:
        return -1
    while True:
        try:
            total = total / a
        except ZeroDivisionError as e:
            raise ValueError(str(e))
    return total
"""


def test_lowering():
    (name, g), = flow.functions(SOURCE)
    after = g.after()
    kinds = [k for k, _ in g.points]
    assert name == "f" and {"loop", "branch", "break", "continue", "try", "except", "raise", "return"} <= set(kinds)
    assert flow.functions("def f(:") == []
    dead = set(range(len(kinds))) - flow.reach(0, after)
    assert all(g.points[p][0] in ("exit", "return") for p in dead if p > 1) or not dead
    assert len(flow.cycles(flow.reach(0, after), after)) == 2
    for d, on in flow.control_dependences(after, 0, 1):
        assert len(after[on]) > 1 and d != 1


def test_regions_and_facts():
    (name, g), = flow.functions(SOURCE)
    after = g.after()
    found = flow.structured(after, 0, 1)
    loops = {head: points for kind, head, _, points in found if kind == "loop"}
    assert sorted(loops) == sorted(min(c, key=lambda p: g.points[p][1]) for c in flow.cycles(flow.reach(0, after), after))
    dom, post = flow.dominators(0, after), flow.dominators(1, flow.turned(after))
    for kind, head, left, points in found:
        assert all(head in dom[p] for p in points if kind != "root")
        if kind == "branch" and left is not None:
            assert left in post[head] and left not in points
    facts = dict(flow.unstructured(g))
    kinds = [k for k, _ in g.points]
    assert facts[kinds.index("break")] == "break" and facts[kinds.index("continue")] == "continue" and facts[kinds.index("raise")] == "raise"


@pytest.mark.parametrize("seed", range(20))
def test_loops_of_random_graphs(seed):
    """Points of natural loops are those that lead back to the head without passing it."""
    after = random_graph(seed + 300)
    after.setdefault(0, []).append(99)
    reached, dom = flow.reach(0, after), flow.dominators(0, after)
    for kind, head, _, points in flow.structured(after, 0, 99):
        if kind == "loop":
            ends = {a for a in reached if head in after.get(a, ()) and head in dom[a]}
            without = {a: [b for b in many if b != head] for a, many in after.items()}
            assert points == {head} | {p for p in reached if flow.reach(p, without) & ends and p != head}


@pytest.mark.parametrize(("glob", "path", "ok"), [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("a/**", "a/b/c", True), ("{a,b}/?.js", "b/x.js", True), ("{a,b}/?.js", "c/x.js", False), ("a.b", "axb", False)])
def test_globs(glob, path, ok):
    import re

    assert bool(re.match(rules.glob_pattern(glob), path)) == ok


def test_registry():
    assert len(rules.RULES) == len({r for r, *_ in rules.RULES}) == 65


def test_scalar_edges(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        X.ratio(F.lit(1), F.lit(0)).alias("a"), X.bounded_ratio(F.lit(5), F.lit(2)).alias("b"), X.saturating(F.lit(-1.0), 4.0).alias("c"), X.maintainability(F.lit(0.0), F.lit(1), F.lit(0)).alias("d"),
        X.ratio_less(F.lit(1), F.lit(3), F.lit(333333333), F.lit(999999999)).alias("e"), X.is_banner(F.lit("----- ")).alias("f"), X.normalized_key(F.lit("Report-Limit_x.y:z")).alias("g"), X.strip_fences(F.lit("```py\nx\n```")).alias("h"), X.generated_source(F.lit("# @generated")).alias("i"),
    ).first()
    assert tuple(row) == (0.0, 1.0, 0.0, 100.0, False, True, "reportlimitxyz", "x", True)


def test_repartitioning_changes_nothing(spark):
    from pyspark.sql import functions as F

    from textloom.operators import duplicates, graphs

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    runs = [sorted(map(tuple, duplicates.within_files(duplicates.windows(docs.repartition(n), "doc_id"), "doc_id").collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    edges = spark.range(60).select((F.col("id") % 17).alias("a"), (F.col("id") * 7 % 19).alias("b"))
    nodes = edges.select("a").union(edges.select("b")).distinct().toDF("node")
    assert len({tuple(sorted(map(tuple, graphs.weak_components(nodes, edges.repartition(n)).collect()))) for n in (1, 5)}) == 1


def test_edit_stream_drops_late_versions(spark, tmp_path):
    from textloom.streaming import edits

    rows = [("a", 1, 0, 0, "hello"), ("a", 3, 5, 5, "!"), ("a", 2, 0, 1, "J"), ("b", 1, 0, 9, "x"), ("b", 2, 0, 0, "y")]
    spark.createDataFrame(rows, edits.EDIT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edits.EDIT).parquet(str(tmp_path / "in"))
    out = edits.collected(edits.applied_edits(stream), "update", "path", "version")
    assert sorted(map(tuple, out.select("path", "text", "version", "rejected").collect())) == [("a", "Jello!", 3, 0), ("b", "y", 2, 1)]


def test_atomic_write_and_undo(spark, tmp_path):
    from textloom.operators import reports

    path = str(tmp_path / "t")
    reports.atomic_write(spark.range(3), path)
    reports.atomic_write(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and reports.undo(spark, path)
    assert spark.read.parquet(path).count() == 3 and not reports.undo(spark, path)


def test_snapshot_of_a_folder(spark, tmp_path):
    from textloom.sources import artefacts

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_text("x = 1\n")
    (tmp_path / "x" / "b.rs").write_bytes(b"\xff\xfe")
    out = {r.path.rsplit("/", 1)[1]: (r.lang, r.status, r.bytes_len) for r in artefacts.snapshot(spark, str(tmp_path)).collect()}
    assert out == {"a.py": ("python", "complete", 6), "b.rs": ("rust", "failed", 2)}


def test_fixpoint_ends_whole_or_fails(spark):
    from textloom.operators import graphs

    e = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    step = lambda new: new.join(e.toDF("b", "c"), "b").selectExpr("a", "c AS b")
    for most in (None, 5):
        assert graphs.fixpoint(e, step, ["a", "b"], most).count() == 21
    with pytest.raises(RuntimeError):
        graphs.fixpoint(e, step, ["a", "b"], 3)


def brute_components(nodes, edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    reach = {n: flow.reach(n, after) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("small", [50_000, 0])
def test_strong_components(spark, monkeypatch, small):
    from textloom.operators import graphs

    monkeypatch.setattr(graphs, "SMALL", small)
    draw = random.Random(31)
    for n, m in ((12, 20),) if small == 0 else ((1, 0), (12, 20), (40, 60), (30, 200)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        e = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.component for r in graphs.strong_components(spark.range(n).toDF("node"), e).collect()}
        assert got == brute_components(range(n), edges)


@pytest.mark.parametrize("small", [50_000, 0])
def test_layers(spark, monkeypatch, small):
    from textloom.operators import graphs

    monkeypatch.setattr(graphs, "SMALL", small)
    draw = random.Random(4)
    edges = sorted({tuple(sorted(draw.sample(range(12), 2), reverse=True)) for _ in range(20)})
    want = {}
    for n in range(12):
        want[n] = max((want[b] + 1 for a, b in edges if a == n), default=0)
    nodes = spark.range(12).toDF("component")
    got = {r.component: r.layer for r in graphs.layers(nodes, spark.createDataFrame(edges, "from_ long, to_ long")).collect()}
    assert got == want
    two = spark.createDataFrame([(1, 2), (2, 1)], "from_ long, to_ long")
    with pytest.raises(Exception, match="cycle"):
        graphs.layers(nodes, two).collect()


def test_long_chains_are_written_together(spark, monkeypatch):
    from textloom.operators import graphs

    monkeypatch.setattr(graphs, "COMPACT", 2)
    e = spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")
    assert graphs.reachable(e, spark.createDataFrame([(0,)], "node long")).count() == 13


def test_digests_and_edits(spark):
    from pyspark.sql import functions as F

    from textloom.operators import reports

    def plain_fnv(t):
        h = 0xCBF29CE484222325
        for b in (t or "").encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    draw = random.Random(8)
    texts = ["", None, "a", "é😀" * 40] + ["".join(draw.choice("abé😀\n") for _ in range(draw.randrange(60))) for _ in range(60)]
    pairs = [(k, a, draw.choice([texts[(k * 7) % len(texts)], (a or "")[:3] + "x" + (a or "")[5:]])) for k, a in enumerate(texts)]
    df = spark.createDataFrame(pairs, "id long, a string, b string").repartition(3)
    out = df.select("*", reports.fnv1a("a").alias("h"), reports.derived_edit("a", "b").alias("e")).collect()
    for r in out:
        a, b = r.a or "", r.b or ""
        assert r.h == plain_fnv(r.a) and a[: r.e.start] + r.e.replacement + a[r.e.end :] == b
        n = min(len(a), len(b))
        assert r.e.start == next((k for k in range(n) if a[k] != b[k]), n)
    assert df.select(F.count(reports.fnv1a("a"))).first()[0] == len(pairs)


def test_budgets_are_cut_in_order(spark):
    from textloom.operators import planning

    items = spark.createDataFrame([(k, (k * 7) % 5 + 1) for k in range(200)], "id long, cost long").repartition(6)
    got = sorted((r.id, r.running) for r in planning.budgeted(items, "id", "cost", 100).collect())
    want, total = [], 0
    for k in range(200):
        total += (k * 7) % 5 + 1
        if total <= 100:
            want.append((k, total))
    assert got == want
    assert planning.budgeted(items, "id", "cost", 50, after=20).agg(F_min()).first()[0] == 21


def F_min():
    from pyspark.sql import functions as F

    return F.min("id")
