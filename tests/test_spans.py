"""Sweeps over spans against all pairs: overlaps in total and narrowest regions, without a join of pairs."""

import random

from textloom.operators import duplicates as D

SCHEMA = "path string, {} long, start long, end long"


def _drawn(spark, seed, n, m):
    draw = random.Random(seed)

    def some(count):
        rows = [(draw.choice(["a", "b"]), k, s := draw.choice([0, 63, 64, draw.randrange(9000)]), s + draw.choice([1, 5, 64, draw.randrange(1, 3000)])) for k in range(count)]
        return [*rows, *((p, 1000 + k, s, e) for p, k, s, e in rows[: count // 4])]  # equal spans too

    a, b = some(n), [(None, -1, 0, 9), ("c", -2, 0, 9), *some(m)]
    return a, b, spark.createDataFrame(a, SCHEMA.format("id")), spark.createDataFrame(b, SCHEMA.format("region"))


def _pair_joins(df):
    """Joins of spans by the buckets that they are in: they make a row for each pair."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "cell" in line]


def test_overlap_totals_equal_those_of_all_pairs(spark):
    for block in (64, 4096):
        a, b, p, q = _drawn(spark, 3, 120, 90)
        df = D.overlap_totals(p, q, ["path"], "id", block)
        assert not _pair_joins(df)
        want = {}
        for path, region, s, e in b:
            met = [i for p_, i, s_, e_ in a if p_ == path and s_ < e and s < e_]
            want[region] = (len(met), sum(met))
        got = {r.region: (r.n, r.total) for r in df.collect()}
        assert got == {k: got.get(k, v) for k, v in want.items() if k != -1}
        assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if v[0]}


def test_narrowest_owner_equals_that_of_all_pairs(spark):
    for seed in range(3):
        a, b, p, q = _drawn(spark, seed, 120, 90)
        df = D.narrowest_owner(p, q, ["path"])
        assert not _pair_joins(df)
        want = []
        for path, k, s, e in a:
            around = [(e_ - s_, s_, r) for p_, r, s_, e_ in b if p_ == path and s_ <= s and e <= e_]
            want.append((path, k, min(around)[2] if around else None))
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_span_queries_make_no_pairs(spark):
    from textloom.plans import catalogue

    for name in ("span_overlap_join", "narrowest_enclosing"):
        assert not _pair_joins(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")), name
