"""Slices, independent parts and single-entry single-exit regions against plain searches on random graphs."""

import itertools
import random

import pytest

from textloom.operators import owners, regions, slicing


def reach(start, after, without=None):
    seen, stack = {start}, [start]
    while stack:
        a = stack.pop()
        for b in after.get(a, ()):
            if (a, b) != without and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def turned(edges):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def dependences(seed):
    draw = random.Random(seed)
    return [(o, draw.randrange(12), draw.randrange(12), draw.choice("xyz")) for o in range(8) for _ in range(draw.randrange(0, 14))]


@pytest.mark.parametrize("forward", [False, True])
def test_slices_and_groups(spark, forward):
    rows, draw = dependences(3), random.Random(5)
    criteria = [(o, draw.randrange(12)) for o in range(9) for _ in range(3)] + [(None, 1), (1, None)]
    dep = spark.createDataFrame([*rows, *rows[:5], (None, 1, 2, "x"), (0, None, 2, "x")], "owner long, src long, dst long, variable string")
    got = slicing.slices(dep, spark.createDataFrame(criteria, "owner long, point long"), forward)
    want = set()
    for o, c in criteria:
        if o is not None and c is not None:
            after = turned([(a, b) if forward else (b, a) for p, a, b, _ in rows if p == o])
            want |= {(o, c, x) for x in reach(c, after)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    held: dict = {}
    for o, c, x in want:
        held.setdefault((o, c), set()).add(x)
    groups = {}
    for o in {o for o, _ in held}:
        left = sorted(c for p, c in held if p == o)
        while left:
            group, points = {left[0]}, set(held[o, left[0]])
            while more := {c for c in left if c not in group and held[o, c] & points}:
                group |= more
                points = set().union(*(held[o, c] for c in group))
            groups |= {(o, c): (min(group), len(points)) for c in group}
            left = [c for c in left if c not in group]
    found = slicing.independent_groups(got)
    assert {(r.owner, r.criterion): r.grp for r in found.collect()} == {k: g for k, (g, _) in groups.items()}
    points = spark.createDataFrame([(o, x) for o in range(9) for x in range(12)] * 2, "owner long, point long")
    parts = slicing.splits(points, got, found).collect()
    assert {(r.owner, r.grp): r.statements for r in parts} == {(o, g): n for (o, _), (g, n) in groups.items()}
    for r in parts:
        own = {g: n for (o, _), (g, n) in groups.items() if o == r.owner}
        assert r.alone == 12 - sum(own.values()) and r.splittable == (sum(n >= 2 for n in own.values()) >= 2)


def test_last_writes(spark):
    draw = random.Random(9)
    rows = [(o, k, draw.randrange(5), draw.choices("abc", k=draw.randrange(3)), draw.choices(["a", "b", "c", None], k=draw.randrange(3))) for o in (1, 2, None) for k in range(30)]
    s = spark.createDataFrame(rows, "o long, id long, at long, reads array<string>, writes array<string>")
    got = slicing.last_writes(s, "o", "id", ["at"], s["reads"], s["writes"]).collect()
    want = set()
    for o, i, at, reads, _ in rows:
        for v in set(reads):
            before = [(t, j) for p, j, t, _, w in rows if p == o and v in w and (t, j) < (at, i)]
            if o is not None and before:
                want.add((o, max(before)[1], i, v))
    assert set(map(tuple, got)) == want and len(got) == len(want)


def graphs():
    """Ladders, nested branches and loops, and random walks with chords, a dead end and points beyond reach."""
    out = [[(0, 1), (1, 99)], [(0, 1), (1, 2), (2, 3), (1, 3), (3, 99)], [(0, 1), (1, 2), (2, 1), (2, 3), (3, 99)], [(0, 1), (1, 1), (1, 99)], [(0, 1), (1, 2)]]
    draw = random.Random(2)
    for _ in range(14):
        size = draw.randrange(3, 11)
        walk = [0, *[draw.randrange(1, size) for _ in range(draw.randrange(2, 14))], 99]
        out.append(sorted(set(zip(walk, walk[1:]))) + [(50, 3), (2, 60)])
    return out


def brute_regions(edges):
    after = turned(edges)
    back = turned([(b, a) for a, b in edges])
    on = [(a, b) for a, b in set(edges) if a in reach(0, after) and b in reach(99, back)]
    if not on:
        return [], {}
    closed = turned([*on, (99, 0)])
    alone = lambda e, f: e[0] in reach(e[1], closed, f)  # noqa: E731  a cycle with e and without f
    same = lambda e, f: e == f or not alone(e, f) and not alone(f, e)
    classes = []
    for e in sorted(on):
        group = next((g for g in classes if same(g[0], e)), None)
        classes.append([e]) if group is None else group.append(e)
    inner = turned(on)
    found = {}
    for g in classes:
        # e is before f if no way from the entry gets to f without e
        row = sorted(g, key=lambda f: sum(e != f and f[0] not in reach(0, inner, e) for e in g))
        for e, f in zip(row, row[1:]):
            found[e, f] = reach(e[1], inner, f)
    return sorted(map(sorted, classes)), found


def test_regions(spark):
    these = graphs()
    edges = spark.createDataFrame([(o, a, b) for o, g in enumerate(these) for a, b in [*g, g[0]]] + [(None, 0, 1), (3, None, 1)], "owner long, src long, dst long")
    classes: dict = {}
    for r in regions.edge_classes(edges, 0, 99).collect():
        classes.setdefault((r.owner, r["class"]), []).append((r.src, r.dst))
    want = [brute_regions(g) for g in these]
    for o in range(len(these)):
        assert sorted(sorted(v) for (p, _), v in classes.items() if p == o) == want[o][0], these[o]
    found = regions.regions(edges, 0, 99)
    points = regions.region_points(found, edges, 0, 99)
    names = {(r.owner, r.region): ((r.entry_src, r.entry_dst), (r.exit_src, r.exit_dst)) for r in found.collect()}
    held: dict = {}
    for r in points.collect():
        held.setdefault((r.owner, names[r.owner, r.region]), set()).add(r.point)
    assert held == {(o, k): v for o, (_, g) in enumerate(want) for k, v in g.items()} and len(held) > 15
    tree = regions.region_tree(points).collect()
    assert len(tree) == len(held)
    for r in tree:
        own = held[r.owner, names[r.owner, r.region]]
        around = [v for (o, _), v in held.items() if o == r.owner and own < v]
        apart = [v for (o, _), v in held.items() if o == r.owner and own & v and not own <= v and not v <= own]
        assert not apart and r.size == len(own)
        assert (held[r.owner, names[r.owner, r.parent]] if r.parent is not None else None) == min(around, key=len, default=None)
    draw = random.Random(1)
    dep = [(o, draw.choice(ends), draw.choice(ends), draw.choice("xyz")) for o, g in enumerate(these) for ends in [sorted(set(itertools.chain(*g)))] for _ in range(8)]
    for r in regions.signatures(points, spark.createDataFrame(dep, "owner long, src long, dst long, variable string")).collect():
        own = held[r.owner, names[r.owner, r.region]]
        assert r.parameters == sorted({v for o, a, b, v in dep if o == r.owner and b in own and a not in own})
        assert r.results == sorted({v for o, a, b, v in dep if o == r.owner and a in own and b not in own})


def test_empty(spark):
    none = spark.createDataFrame([], "owner long, src long, dst long")
    assert regions.regions(none, 0, 99).count() == 0
    dep = spark.createDataFrame([], "owner long, src long, dst long, variable string")
    sliced = slicing.slices(dep, spark.createDataFrame([(1, 2)], "owner long, point long"))
    assert [tuple(r) for r in sliced.collect()] == [(1, 2, 2)] and slicing.independent_groups(sliced.limit(0)).count() == 0


def test_large_owners_go_by_rounds(spark, monkeypatch):
    """Owners on either side of what one task takes have the same classes and regions; in tasks there are no rounds of jobs."""
    draw = random.Random(9)
    rows = {(o, *e) for o in range(8) for e in [(0, 1), (1, 2), (2, 99)] + [(draw.randrange(6), draw.choice([1, 2, 3, 4, 5, 99])) for _ in range(2 + o)]}
    edges = spark.createDataFrame(sorted(rows), "owner long, src long, dst long")
    got, jobs = [], []
    for most in (owners.graphs.SMALL, 9):
        monkeypatch.setattr(owners.graphs, "SMALL", most)
        spark.sparkContext.setJobGroup(f"regions {most}", "")
        found = regions.regions(edges, 0, 99)
        results = (regions.edge_classes(edges, 0, 99), found, regions.region_points(found, edges, 0, 99))
        got.append([sorted(map(str, df.collect())) for df in results])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"regions {most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] and all(got[0]) and jobs[0] < 100 < jobs[1]
