"""Constants and chains of tests against a worklist over dictionaries, random runs, and walks from test to test."""

import json
import math
import random
from collections import defaultdict

from textloom.operators import constants, graphs
from textloom.plans.catalogue import QUERIES

EDGES = "owner long, src long, dst long, variable long, value long, holds boolean"
EFFECTS = "owner long, point long, variable long, kind string, value long, source long"
ENTRIES = "owner long, point long"
VARYING = object()


def after_effect(state, effects):
    out = dict(state)
    for variable, (kind, value, source) in effects.items():
        out[variable] = value if kind == "constant" else state.get(source, VARYING) if kind == "copy" else VARYING
    return out


def is_open(edge, state):
    _, variable, value, holds = edge
    known = state.get(variable, VARYING) if variable is not None else VARYING
    return known is VARYING or value is None or (known == value) == holds


def brute(edges, effects, entries, variables):
    """States before points, and the edges' statuses, by a worklist that carries one state over one edge at a time."""
    out_of = defaultdict(set)
    for src, *rest in edges:
        out_of[src].add(tuple(rest))
    state = {p: dict.fromkeys(variables, VARYING) for p in entries}
    work = list(entries)
    while work:
        p = work.pop()
        after = after_effect(state[p], effects.get(p, {}))
        for edge in out_of[p]:
            if is_open(edge, after):
                dst = edge[0]
                if dst not in state:
                    state[dst] = dict(after)
                    work.append(dst)
                else:
                    met = {v: x if x is not VARYING and x == after.get(v, VARYING) else VARYING for v, x in state[dst].items()}
                    if met != state[dst]:
                        state[dst] = met
                        work.append(dst)
    status = set()
    for src, dst, variable, value, holds in edges:
        if src not in state:
            kind = "unreached"
        else:
            known = after_effect(state[src], effects.get(src, {})).get(variable, VARYING)
            kind = "open" if variable is None or value is None or known is VARYING else "always" if (known == value) == holds else "dead"
        status.add((src, dst, variable, value, holds, kind))
    return {(p, v, x) for p, s in state.items() for v, x in s.items() if x is not VARYING} | {(p, None, None) for p in state}, status


def program(draw):
    n, variables = draw.randint(2, 9), range(3)
    edges, effects = set(), {}
    for p in range(n):
        for _ in range(draw.randint(1, 2)):
            if draw.random() < 0.6:
                v, c = draw.choice(variables), draw.randrange(2)
                edges |= {(p, draw.randrange(n + 1), v, c, True), (p, draw.randrange(n + 1), v, c, False)}
            else:
                edges.add((p, draw.randrange(n + 1), None, None, None))
        for v in variables:
            if draw.random() < 0.4:
                effects.setdefault(p, {})[v] = draw.choice([("constant", draw.randrange(2), None), ("copy", None, draw.choice(variables)), ("varying", None, None)])
    return edges, effects, [0]


def test_against_a_worklist_and_random_runs(spark):
    draw = random.Random(5)
    programs = {k: program(draw) for k in range(60)}
    edges = spark.createDataFrame([(k, *e) for k, (es, _, _) in programs.items() for e in sorted(es, key=str)] * 2, EDGES)
    effects = spark.createDataFrame([(k, p, v, *e) for k, (_, fs, _) in programs.items() for p, f in fs.items() for v, e in f.items()] * 2, EFFECTS)
    entries = spark.createDataFrame([(k, p) for k, (_, _, ps) in programs.items() for p in ps], ENTRIES)
    state = constants.propagate(edges, effects, entries)
    got, arms = defaultdict(list), defaultdict(list)
    for r in state.collect():
        got[r.owner].append((r.point, r.variable, r.value))
    for r in constants.arms(edges, effects, state).collect():
        arms[r.owner].append((r.src, r.dst, r.variable, r.value, r.holds, r.status))
    statuses = set()
    for k, (es, fs, ps) in programs.items():
        want, status = brute(es, fs, ps, range(3))
        assert len(got[k]) == len(want) and set(got[k]) == want
        assert len(arms[k]) == len(status) and set(arms[k]) == status
        statuses |= {s[-1] for s in status}
        known = {(p, v): x for p, v, x in want if v is not None}
        dead = {s[:5] for s in status if s[-1] == "dead"}
        for _ in range(30):  # no run of the program meets another value, or takes a dead arm
            p, values = 0, {v: draw.randrange(2) for v in range(3)}
            for _ in range(20):
                assert (p, None, None) in want and all(known.get((p, v), x) == x for v, x in values.items())
                after = after_effect(values, fs.get(p, {}))
                values = {v: draw.randrange(2) if x is VARYING else x for v, x in after.items()}
                ways = [e for e in es if e[0] == p and is_open(e[1:], values)]
                if not ways:
                    break
                way = draw.choice(sorted(ways, key=str))
                assert way not in dead
                p = way[1]
    assert statuses == {"open", "always", "dead", "unreached"}


def test_large_owners_go_by_rounds(spark, monkeypatch):
    """Owners on either side of what one task takes have the same facts."""
    draw = random.Random(6)
    programs = {k: program(draw) for k in range(12)}
    edges = spark.createDataFrame([(k, *e) for k, (es, _, _) in programs.items() for e in sorted(es, key=str)], EDGES)
    effects = spark.createDataFrame([(k, p, v, *e) for k, (_, fs, _) in programs.items() for p, f in fs.items() for v, e in f.items()], EFFECTS)
    entries = spark.createDataFrame([(k, p) for k, (_, _, ps) in programs.items() for p in ps], ENTRIES)
    got, jobs = [], []
    for most in (graphs.SMALL, 20):
        monkeypatch.setattr(graphs, "SMALL", most)
        spark.sparkContext.setJobGroup(f"constants {most}", "")
        got.append(sorted(map(str, constants.propagate(edges, effects, entries).collect())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"constants {most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] and jobs[0] < 40 < jobs[1]


def test_odd_rows(spark):
    edges = spark.createDataFrame([(1, 0, 1, None, None, None), (1, 1, 2, 7, 1, True), (1, 1, 3, 7, 1, False), (1, 1, 4, 7, None, True), (None, 0, 1, None, None, None), (1, None, 1, None, None, None), (2, 0, 1, None, None, None)], EDGES)
    effects = spark.createDataFrame([(1, 0, 7, "constant", 1, None), (1, 1, 8, "constant", 1, None), (1, 1, 8, "constant", 2, None), (1, 1, 9, "odd", 1, None), (1, 0, 9, "constant", 4, None), (1, 1, 6, "copy", None, None)], EFFECTS)
    entries = spark.createDataFrame([(1, 0), (1, 0), (None, 0), (3, None)], ENTRIES)
    state = constants.propagate(edges, effects, entries)
    assert {tuple(r) for r in state.collect()} == {(1, 0, None, None), (1, 1, None, None), (1, 1, 7, 1), (1, 1, 9, 4), (1, 2, None, None), (1, 2, 7, 1), (1, 4, None, None), (1, 4, 7, 1)}
    status = {(r.owner, r.src, r.dst): r.status for r in constants.arms(edges, effects, state).collect()}
    assert status == {(1, 0, 1): "open", (1, 1, 2): "always", (1, 1, 3): "dead", (1, 1, 4): "open", (2, 0, 1): "unreached"}
    none = constants.propagate(edges.limit(0), effects.limit(0), entries.limit(0))
    assert none.count() == 0 and constants.arms(edges.limit(0), effects.limit(0), none).count() == 0


def test_chains(spark):
    tests = [(1, k, 5, k % 3, 100 + k, k + 1) for k in range(20)]  # one chain of twenty
    tests += [(1, 30, 5, 1, 99, 31), (1, 31, 6, 1, 99, 32), (1, 32, 6, 2, 99, 33), (1, 33, 6, 2, 99, 40)]  # another variable at 31, another way into 33
    tests += [(1, 50, 5, 1, 99, 51), (1, 51, 5, 2, 99, 50), (None, 1, 1, 1, 1, 1), (2, 1, 5, None, 9, 2), (2, 2, 5, None, 9, 3), (2, 3, None, 1, 9, 4), (2, 4, None, 1, 9, 5)]
    schema = "owner long, point long, variable long, value long, hit long, miss long"
    edges = [(o, p, x) for o, p, _, _, hit, miss in tests for x in (hit, miss)] + [(1, 98, 33)]
    found = constants.chains(spark.createDataFrame(tests + tests[:3], schema), spark.createDataFrame(edges * 2, "owner long, src long, dst long")).collect()
    got = {(r.owner, r.point): (r.head, r.place, r.repeated, r.size, r.otherwise) for r in found}
    want = {(1, k): (0, k, k > 2, 20, 20) for k in range(20)}
    want |= {(1, 30): (30, 0, False, 1, 31), (1, 31): (31, 0, False, 2, 33), (1, 32): (31, 1, False, 2, 33), (1, 33): (33, 0, False, 1, 40)}
    want |= {(2, 1): (1, 0, False, 2, 3), (2, 2): (1, 1, False, 2, 3), (2, 3): (3, 0, False, 1, 4), (2, 4): (4, 0, False, 1, 5)}
    assert got == want and len(found) == len(want)
    assert constants.chains(spark.createDataFrame([], schema), spark.createDataFrame([], "owner long, src long, dst long")).count() == 0


def test_event_arms(spark):
    folder = "/root/testdata/sf0.001"
    walks = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        k, v = json.loads(r.props)["k"], math.floor(r.value)
        walks[r.user_id].append((f"{r.event_type}/{k // 10}", r.event_type, k // 10, v))
    want = set()
    for user, walk in walks.items():
        least, at, before = {}, {}, ""
        for point, kind, slot, v in walk:
            least[before, point] = min(least.get((before, point), 9), v % 3)
            at[point] = (kind, slot, min(v, at[point][2]) if point in at else v)
            before = point
        least[before, "~"] = min(least.get((before, "~"), 9), 0)
        edges = {(s, d, int(s.split("/")[1]), w, True) if s.startswith("view/") else (s, d, None, None, None) for (s, d), w in least.items()}
        make = {"purchase": lambda v: ("constant", v % 3, None), "click": lambda v: ("copy", None, v % 10), "error": lambda v: ("varying", None, None)}
        effects = {p: {slot: make[kind](v)} for p, (kind, slot, v) in at.items() if kind in make}
        want |= {(user, *s) for s in brute(edges, effects, [""], range(10))[1]}
    rows = [(r.owner, r.src, r.dst, r.variable, r.value, r.holds, r.status) for r in QUERIES["event_arms"](spark, folder).collect()]
    assert set(rows) == want and len(rows) == len(want) and any(r[-1] == "dead" for r in rows)
