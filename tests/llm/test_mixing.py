import hashlib
import re

import pytest

from tests.llm import fixtures
from textloom.llm import mixing


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    slope = {s: mixing.SLOPES[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while True:  # the rule step by step: share, stop at the limit, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
        free -= over
    out, at = [], dict.fromkeys(sources, 0)
    for r in sorted(rows, key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), size(r[1]))):
        s, n = r[3], size(r[1])
        full = int(target[s] // total[s]) if total[s] else 0
        taken = full * n + max(0, min(n, round(target[s] - full * total[s]) - at[s]))
        place = None
        if taken:
            low, high = 0.0, 1.0  # invert the integral of the schedule by halving
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if (1 - slope[s]) * t + slope[s] * t * t < at[s] / target[s] else (low, t)
            place = (low + high) / 2
        out.append((r[0], n, total[s], target[s], taken, place))
        at[s] += n
    return out


def test_against_brute_force(spark):
    rows = fixtures.documents()
    got = mixing.mix(spark.createDataFrame(rows, fixtures.DOCS)).collect()
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    want = sorted(brute(rows), key=lambda x: (str(x[0]), x[1]))
    got = sorted(map(tuple, got), key=lambda x: (str(x[0]), x[1]))
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:5] == pytest.approx(b[3:5], abs=1) and (a[5] is None) == (b[5] is None)
        assert a[5] is None or a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[4] <= 3 * a[1]
    for source_size, target in {(x[2], x[3]) for x in got}:
        taken = sum(x[4] for x in got if (x[2], x[3]) == (source_size, target))
        assert taken == pytest.approx(target, abs=2)


def test_limits_and_rest(spark):
    rows = [(k, "w " * 10, "en", s, 1) for k, s in enumerate(["a"] * 1 + ["b"] * 5 + ["c"] * 40)] + [(99, "", "en", "d", 0)]
    out = mixing.mix(spark.createDataFrame(rows, fixtures.DOCS)).collect()
    by = {(r.source_size, r.target) for r in out}
    assert (10, 30.0) in by and (50, 150.0) in by and (400, 280.0) in by and (0, 0.0) in by
    again = mixing.mix(spark.createDataFrame(rows[::-1], fixtures.DOCS)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "y")], "doc_id long, text string, source string, size int, target string")
    row = mixing.mix(docs, carry=True).first()
    assert row.size == 2 and row.row.size == 7 and row.row.target == "y"
    assert mixing.mix(docs.limit(0)).count() == 0


def test_every_pass_has_its_position(spark):
    """Weight-5 sources are read more than once; the later passes lie in the later part of the curriculum."""
    rows = [(k, "w " * (5 + k % 7), "en", f"s{k % 20:02}", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    whole = {r.row.doc_id: r for r in mixing.mix(docs, carry=True).collect()}
    out = mixing.mix(docs, carry=True, passes=True).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    by = {}
    for r in out:
        by.setdefault(r.row.doc_id, []).append(r)
    assert any(len(x) > 1 for x in by.values())
    for i, r in whole.items():
        mine = sorted(by.get(i, []), key=lambda x: x["pass"])
        assert [x["pass"] for x in mine] == list(range(len(mine))) and sum(x.taken for x in mine) == r.taken
        assert all(0 < x.taken <= r.size for x in mine) and [x.position for x in mine] == (r.positions or [])
        assert r.position == (r.positions or [None])[0]
    schedule = lambda s, t: (1 - s) * t + s * t * t
    slope = {f"s{k:02}": mixing.SLOPES[k % 3] for k in range(20)}
    for source in slope:  # each source's intervals fill its whole demand, one after the other
        at = 0
        for r in sorted((x for x in out if x.row.source == source), key=lambda x: x.position):
            assert schedule(slope[source], r.position) * r.target == pytest.approx(at, abs=1e-6)
            at += r.taken
        assert at == pytest.approx(r.target, abs=1)


def test_many_sources_and_odd_names(spark):
    """Sources are ranked over ranges of their names, and columns may be called anything."""
    rows = [(k, "w " * (1 + k % 7), "en", None if k % 50 == 0 else f"host{k % 90:03d}", 1) for k in range(900)]
    got = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, fixtures.DOCS)).collect()))
    for a, b in zip(got, sorted(brute(rows)), strict=True):
        assert a[:3] == b[:3] and a[3:5] == pytest.approx(b[3:5], abs=1)
    odd = spark.createDataFrame(rows, fixtures.DOCS).withColumnRenamed("lang", "a.b").withColumnRenamed("n_chars", "w`x")
    out = mixing.mix(odd, carry=True)
    assert out.schema["row"].dataType.names == ["doc_id", "text", "a.b", "source", "w`x"] and out.count() == 900
