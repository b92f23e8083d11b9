"""Queries of contracts over revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import contracts as C
from textloom.operators import graphs as G
from textloom.plans.registry import literal_sql, query

# ix, path, name, refs, literals, config_keys, calls as text, loops, fp: three revisions of our own making
ROWS = [
    (0, "a.py", "owner", ["old.rate", "load"], ["x"], ["LIMIT"], "", 2, "f1"), (0, "a.py", "reader", ["old.rate"], [], [], "", 0, "f2"), (0, "a.py", "other", ["np.round"], ["LIMIT"], [], "", 0, "f3"),
    (0, "tests/test_a.py", "test_rate", ["old.rate"], [], [], "", 0, "f4"), (0, "a.py", "build_row", ["dict"], ["id", "rate"], [], "", 0, "f5"), (0, "a.py", "verify_row", ["dict"], ["id", "rate"], [], "", 0, "f6"),
    (0, "a.py", "check_in", ["user", "role", "age"], [], [], "", 0, "g1"), (0, "a.py", "check_out", ["user", "role", "age"], [], [], "", 0, "g2"),
    (1, "a.py", "owner", ["new.rate", "load", "itertools.chain"], ["x"], [], "", 1, "f1b"), (1, "a.py", "reader", ["old.rate"], [], [], "", 0, "f2"), (1, "a.py", "other", ["np.round"], ["LIMIT"], [], "", 0, "f3b"),
    (1, "tests/test_a.py", "test_rate", ["old.rate"], [], [], "", 0, "f4"), (1, "a.py", "build_row", ["dict"], ["id", "price"], [], "", 0, "f5b"), (1, "a.py", "verify_row", ["dict"], ["id", "rate"], [], "", 0, "f6"),
    (1, "a.py", "check_in", ["user", "role", "age", "math.isnan"], [], [], "", 0, "g1b"), (1, "a.py", "check_out", ["user", "role", "age"], [], [], "", 0, "g2"),
    (2, "a.py", "owner", ["new.rate", "load"], ["x"], [], "", 1, "f1c"), (2, "a.py", "reader", ["old.rate"], [], [], "", 0, "f2"), (2, "a.py", "publish", ["status.write", "DEBUG_MODE"], ["DEBUG_MODE"], [], "", 0, "h1"), (2, "a.py", "count", ["metrics.inc"], [], [], "", 0, "h2"),
]
ROWS = [(r[0], r[1], r[2], sorted(r[3]), sorted(r[4]), sorted(r[5]), *r[7:]) for r in ROWS]
COLS = "ix, path, name, refs, literals, config_keys, loops, fp"
_T = literal_sql(ROWS, COLS).replace("[]", "CAST([] AS VARCHAR[])")
_C = f"c AS {_T}, ad AS (SELECT b.ix, b.path, b.name, b.refs AS br, a.refs AS ar, b.literals AS bl, a.literals AS al, b.loops AS bo, a.loops AS ao, b.fp AS bf, a.fp AS af FROM c b JOIN c a ON a.path = b.path AND a.name = b.name AND a.ix = b.ix + 1)"
_X = lambda a, b: f"list_filter({a}, lambda t: NOT list_contains({b}, t))"


def contracts(spark):
    return spark.createDataFrame(ROWS, "ix int, path string, name string, refs array<string>, literals array<string>, config_keys array<string>, loops int, fp string")


def _mig(dom, short, extra=""):
    b, a = f"b{short}", f"a{short}"
    return f"""{_C}, pp AS (SELECT ix, token, count(*) AS holders FROM (SELECT ix, unnest({dom}) AS token FROM c) GROUP BY ALL),
mg AS (SELECT ix, path, name AS owner, {_X(a, b)} AS added, unnest({_X(b, a)}) AS token FROM ad WHERE len({_X(a, b)}) > 0 AND len({_X(b, a)}) > 0),
hd AS (SELECT DISTINCT ix - 1 AS ix, path, unnest({dom}) AS token FROM c),
sv AS (SELECT mg.* FROM mg JOIN pp USING (ix, token) JOIN hd USING (ix, path, token) WHERE holders <= 3 {extra})"""


_REFS = _mig("refs", "r", "AND NOT regexp_matches(string_split(token, '.')[-1], '^[A-Z]')")
_LITS = _mig("literals", "l")


@query("migrations", f"WITH {_REFS} SELECT ix, path, owner, array_to_string(list_sort(list(DISTINCT token)), ',') AS surviving, array_to_string(first(added), ',') AS added FROM sv GROUP BY ix, path, owner")
def _(spark, d):
    return C.migrations(contracts(spark)).select("ix", "path", "owner", F.array_join("surviving", ",").alias("surviving"), F.array_join("added", ",").alias("added"))


def _stale(base, short, where):
    return f"WITH {base}, un AS (SELECT ix, path, name AS dependent, unnest(a{short}) AS token FROM ad WHERE a{short} = b{short}) SELECT un.ix, un.path, owner, dependent, array_to_string(list_sort(list(DISTINCT token)), ',') AS stale FROM un JOIN sv USING (ix, token) WHERE string_split(token, '.')[-1] <> dependent AND {where} GROUP BY ALL"


@query("owner_moved_consumer_stale", _stale(_REFS, "r", "un.path = sv.path AND dependent <> owner"))
def _(spark, d):
    return C.stale_dependents(contracts(spark))


@query("producer_verifier_schema_drift", _stale(_LITS, "l", "un.path = sv.path AND dependent <> owner"))
def _(spark, d):
    return C.stale_dependents(contracts(spark), "literals")


@query("test_oracle_lag", _stale(_REFS, "r", "(regexp_matches(dependent, '^test_') OR regexp_matches(un.path, '(^|/)tests?/'))"))
def _(spark, d):
    """Unchanged tests that hold a token which only survives in its owner's file."""
    return C.stale_dependents(contracts(spark), tests=True)


@query("accepted_config_inert", f"WITH {_C}, rd AS (SELECT DISTINCT ix, unnest(config_keys) AS key FROM c), hl AS (SELECT ix - 1 AS ix, unnest(literals) AS key, path || ':' || name AS holder FROM c) SELECT rd.ix, rd.key, array_to_string(list_sort(list(DISTINCT holder)), ',') AS holders FROM rd JOIN hl USING (ix, key) WHERE NOT EXISTS (SELECT 1 FROM rd n WHERE n.ix = rd.ix + 1 AND n.key = rd.key) GROUP BY ALL")
def _(spark, d):
    return C.inert_config(contracts(spark))


_FL, _LO = (", ".join(repr(x) for x in w) for w in (C.FLATTEN, C.LOSSY))


@query("scope_collapse", f"WITH {_C} SELECT ix, path, name, array_to_string(list_sort(list_filter({_X('ar', 'br')}, lambda t: string_split(t, '.')[-1] IN ({_FL}))), ',') AS gained FROM ad WHERE ao < bo AND len(list_filter({_X('ar', 'br')}, lambda t: string_split(t, '.')[-1] IN ({_FL}))) > 0")
def _(spark, d):
    return C.scope_collapses(contracts(spark))


@query("confidence_provenance_lost", f"WITH {_C} SELECT ix, path, name, array_to_string(list_sort(list_filter(ar, lambda t: string_split(t, '.')[-1] IN ({_LO}))), ',') AS lossy FROM ad WHERE af <> bf AND len(list_filter(ar, lambda t: string_split(t, '.')[-1] IN ({_LO}))) > 0 AND len({_X('ar', 'br')}) = 0")
def _(spark, d):
    return C.lossy_dependents(contracts(spark))


_CALLS = [("f", "score(model(rows, 5), other(rows))", 1, 2), ("f", "model(rows, 5)", 1, 2), ("f", "Point(one(x), two(x), three(x))", 0, 3), ("g", "expensive(load(path), limit=9)", 0, 2), ("g", "short(x)", 0, 5), ("h", "expensive(load(path), limit=8)", 2, 2)]


@query("hot_path_work_duplicated", f"WITH x AS {literal_sql(_CALLS, 'name, call, b, a')}, y AS (SELECT * FROM x WHERE a >= 2 AND b <= 1 AND length(call) >= 24 AND regexp_matches(call, '\\(.*\\(') AND NOT regexp_matches(call, '^([A-Za-z_0-9]+\\.)*[A-Z][A-Za-z0-9_]*\\(')) SELECT 0 AS ix, 'a.py' AS path, name, call, a AS n FROM y WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.name = y.name AND length(z.call) > length(y.call) AND contains(z.call, y.call))")
def _(spark, d):
    x = spark.createDataFrame(_CALLS, "name string, call string, b long, a long")
    side = lambda c, ix: x.where(f"{c} > 0").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("call", c))).alias("calls")).withColumns({"ix": F.lit(ix), "path": F.lit("a.py")})
    names = x.select("name").distinct()
    before = names.join(side("b", 0).drop("ix", "path"), "name", "left").select("name", F.coalesce("calls", F.create_map().cast("map<string,bigint>")).alias("calls"), F.lit(0).alias("ix"), F.lit("a.py").alias("path"))
    return C.repeated_work(before.unionByName(side("a", 1)))


@query("stale_persistence", f"{_stale(_REFS, 'r', 'un.path = sv.path AND dependent <> owner').replace('WITH ', 'WITH st AS (WITH ', 1)}), j AS (SELECT st.ix, st.path, owner, dependent, w.fp AS was FROM st JOIN c0 w ON w.path = st.path AND w.name = dependent AND w.ix = st.ix + 1), k AS (SELECT j.ix, j.path, owner, dependent, min(n.ix) FILTER (n.fp <> was) AS broken, max(n.ix) AS last FROM j JOIN c0 n ON n.path = j.path AND n.name = dependent AND n.ix > j.ix GROUP BY ALL) SELECT ix, path, owner, dependent, coalesce(broken - 1, last) - ix AS persisted FROM k".replace("WITH st AS", f"WITH c0 AS {_T}, st AS", 1))
def _(spark, d):
    c = contracts(spark)
    return C.persistence(c, C.stale_dependents(c))


@query("adoption_chain_incomplete")
def _(spark, d):
    c = contracts(spark)
    return C.chains(("consumer", C.stale_dependents(c)), ("test", C.stale_dependents(c, tests=True).withColumn("path", F.lit("a.py"))))


@query("contract_roles")
def _(spark, d):
    return C.roles(contracts(spark))


@query("schema_mismatch", f"WITH {_C}, o AS (SELECT *, regexp_extract(name, '^(?:build|make|produce|verify|validate|check|read|parse)_(.+)$', 1) AS subject FROM c), p AS (SELECT * FROM o WHERE subject <> '' AND regexp_matches(name, '^(build|make|produce)_')), v AS (SELECT * FROM o WHERE subject <> '' AND NOT regexp_matches(name, '^(build|make|produce)_')) SELECT p.ix, p.path, p.name AS producer, v.name AS verifier, array_to_string(list_sort({_X('p.literals', 'v.literals')}), ',') AS missing, array_to_string(list_sort({_X('v.literals', 'p.literals')}), ',') AS unknown FROM p JOIN v USING (ix, path, subject) WHERE len(p.literals) > 0 AND len(v.literals) > 0 AND p.literals <> v.literals")
def _(spark, d):
    return C.schema_mismatches(contracts(spark))


@query("config_without_reach", f"WITH {_C}, k AS (SELECT DISTINCT ix, path, unnest(literals) AS key FROM c), r AS (SELECT DISTINCT ix, unnest(config_keys) AS key FROM c) SELECT k.* FROM k WHERE regexp_matches(key, '^[A-Z0-9_]{{4,}}$') AND regexp_matches(key, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM r WHERE r.ix = k.ix AND r.key = k.key)")
def _(spark, d):
    return C.unreached_config(contracts(spark))


@query("sibling_gates", f"WITH {_C}, g AS (SELECT * FROM c WHERE regexp_matches(name, '^(check|verify|validate|guard|admit|require)')) SELECT x.ix, x.path, x.name AS x, y.name AS y, len(list_intersect(x.refs, y.refs)) AS shared, array_to_string(list_sort(list_concat({_X('x.refs', 'y.refs')}, {_X('y.refs', 'x.refs')})), ',') AS apart FROM g x JOIN g y ON x.ix = y.ix AND x.path = y.path AND x.name < y.name WHERE len(list_intersect(x.refs, y.refs)) >= 2 AND len({_X('x.refs', 'y.refs')}) + len({_X('y.refs', 'x.refs')}) BETWEEN 1 AND 8")
def _(spark, d):
    return C.sibling_gates(contracts(spark))


@query("sibling_gates_diverged", f"WITH {_C}, g AS (SELECT * FROM c WHERE regexp_matches(name, '^(check|verify|validate|guard|admit|require)')), s AS (SELECT x.ix, x.path, x.name AS x, y.name AS y FROM g x JOIN g y ON x.ix = y.ix AND x.path = y.path AND x.name < y.name WHERE len(list_intersect(x.refs, y.refs)) >= 2 AND len({_X('x.refs', 'y.refs')}) + len({_X('y.refs', 'x.refs')}) BETWEEN 1 AND 8) SELECT * FROM s WHERE ix > 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.ix = s.ix - 1 AND b.path = s.path AND b.x = s.x AND b.y = s.y)")
def _(spark, d):
    s = C.sibling_gates(contracts(spark)).select("ix", "path", "x", "y")
    return s.where("ix > 0").join(s.withColumn("ix", F.col("ix") + 1), ["ix", "path", "x", "y"], "left_anti")


_SOURCES = [(0, "m.py", "def run(rows):\n    limit = config.get('LIMIT')\n    for r in rows:\n        log.info(r)\n    return limit\n"), (1, "m.py", "def run(rows):\n    log.info(rows)\n    return 'LIMIT'\n"), (1, "bad.py", "def broken(:\n")]


@query("contract_extraction")
def _(spark, d):
    out = C.extract(spark.createDataFrame(_SOURCES, "ix int, path string, text string"))
    return out.select("ix", "path", "name", *[F.array_join(c, ",").alias(c) for c in ("refs", "literals", "config_keys")], "loops", F.map_keys("calls").alias("calls"))


_CALLG = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "tok.x"), ("d", "tok.y"), ("a", "tok.z")]


@query("terminal_references", f"WITH RECURSIVE e AS {literal_sql(_CALLG, 'a, b')}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS function, array_to_string(list_sort(list(DISTINCT b)), ',') AS terminals FROM r WHERE b NOT IN (SELECT a FROM e) GROUP BY a")
def _(spark, d):
    """Tokens in the closure of each function that name no function themselves."""
    e = spark.createDataFrame(_CALLG, "a string, b string")
    return G.closure(e).join(e.select(F.col("a").alias("b")).distinct(), "b", "left_anti").groupBy(F.col("a").alias("function")).agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("terminals"))


_SURF = [
    (0, "g.py", "owner", ["old.rate", "base"], "s1"), (0, "g.py", "check_rate", ["helper"], "s2"), (0, "g.py", "helper", ["old.rate"], "s3"), (0, "g.py", "report", ["metrics.inc", "old.rate"], "s4"), (0, "g.py", "publish", ["status.set", "other"], "s5"), (0, "g.py", "run_all", ["base"], "s6"),
    (1, "g.py", "owner", ["new.rate", "base"], "s1b"), (1, "g.py", "check_rate", ["helper"], "s2"), (1, "g.py", "helper", ["old.rate"], "s3"), (1, "g.py", "report", ["metrics.inc", "old.rate"], "s4"), (1, "g.py", "publish", ["status.set", "other"], "s5"), (1, "g.py", "run_all", ["base"], "s6"),
]
_SURF = [(a, b, n, sorted(r), f) for a, b, n, r, f in _SURF]
_S = f"""c AS {literal_sql(_SURF, 'ix, path, name, refs, fp')}, rf AS (SELECT DISTINCT ix, name, unnest(refs) AS token FROM c), cl AS (SELECT rf.ix, rf.name, c.name AS via FROM rf JOIN c ON c.ix = rf.ix AND c.name = string_split(rf.token, '.')[-1]), rr AS (SELECT * FROM rf UNION SELECT rr.ix, cl.name, rr.token FROM rr JOIN cl ON cl.ix = rr.ix AND cl.via = rr.name),
sk AS (SELECT ix, path, name, CASE WHEN regexp_matches(name, '^(check|verify|validate)') THEN 'gate' WHEN list_contains(list_transform(refs, lambda r: string_split(r, '.')[-2]), 'metrics') THEN 'telemetry' WHEN list_contains(list_transform(refs, lambda r: string_split(r, '.')[-2]), 'status') THEN 'identity' END AS kind FROM c)"""


def _surfaces(spark):
    return spark.createDataFrame(_SURF, "ix int, path string, name string, refs array<string>, fp string").withColumns({"literals": F.array().cast("array<string>"), "config_keys": F.array().cast("array<string>"), "loops": F.lit(0)})


@query("reference_closure", f"WITH RECURSIVE {_S} SELECT * FROM rr")
def _(spark, d):
    return C.reach_of(_surfaces(spark))


@query("retired_surfaces", f"WITH RECURSIVE {_S} SELECT 0 AS ix, 'owner' AS owner, sk.kind, sk.name FROM sk JOIN c b ON b.ix = 0 AND b.name = sk.name AND b.path = sk.path JOIN c a ON a.ix = 1 AND a.name = sk.name AND a.path = sk.path AND a.fp = b.fp WHERE sk.ix = 1 AND kind IS NOT NULL AND EXISTS (SELECT 1 FROM rr WHERE rr.ix = 1 AND rr.name = sk.name AND token = 'old.rate') AND NOT EXISTS (SELECT 1 FROM rr WHERE rr.ix = 1 AND rr.name = sk.name AND token = 'new.rate')")
def _(spark, d):
    """Gates, telemetry and identity surfaces that still read what an owner gave up."""
    return C.retired_surfaces(_surfaces(spark))


@query("contract_splits", f"WITH RECURSIVE {_S}, en AS (SELECT ix, name, token FROM rr WHERE string_split(token, '.')[-1] NOT IN (SELECT name FROM c)) SELECT b.ix, b.path, b.name AS behaviour, s.name AS surface, s.kind FROM c b JOIN sk s ON s.ix = b.ix AND s.path = b.path WHERE regexp_matches(b.name, '^(decide|step|train|run|resume|execute|apply|process)') AND s.kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM en x JOIN en y ON x.ix = y.ix AND x.token = y.token WHERE x.ix = b.ix AND x.name = b.name AND y.name = s.name)")
def _(spark, d):
    return C.contract_splits(_surfaces(spark))


@query("untested_dimensions")
def _(spark, d):
    rows = [(0, "m.py", "merge", ["np.concat"], {}), (0, "m.py", "join_all", ["np.stack"], {}), (0, "tests/test_m.py", "test_a", ["merge"], {"merge(a)": 1, "merge(b)": 1, "join_all(a)": 2})]
    return C.untested_dimensions(spark.createDataFrame(rows, "ix int, path string, name string, refs array<string>, calls map<string,bigint>"))
