"""The regions of users' walks against plain searches for cycles; slices and parts have SQL."""

import json
import math

from tests.test_slices_and_regions import brute_regions
from textloom.plans.catalogue import QUERIES


def test_event_regions(spark):
    folder = "/root/testdata/sf0.001"
    events = sorted((r.user_id, r.ts, r.event_id, r.event_type, r.value, r.props) for r in spark.read.parquet(f"{folder}/events.parquet").collect())
    steps, flows, walks = {}, {}, {}
    for user, _, _, kind, value, props in events:
        k = json.loads(props)["k"]
        walks.setdefault(user, []).append((f"{kind}/{k // 10}", k, math.floor(value) % 100))
    number, want = {"": 0, "~": 99}, set()
    for user, walk in walks.items():
        points = ["", *(p for p, _, _ in walk), "~"]
        for p in points:
            number.setdefault(p, 1000 + len(number))
        steps[user] = {(number[a], number[b]) for a, b in zip(points, points[1:])}
        wrote: dict = {}
        for p, k, r in walk:
            if r in wrote:
                flows.setdefault(user, set()).add((number[wrote[r]], number[p], r))
            wrote[k] = p
    name = {v: k for k, v in number.items()}
    for user, edges in steps.items():
        found = brute_regions(edges)[1]
        for (a, b), own in found.items():
            parameters = sorted({v for s, t, v in flows.get(user, ()) if t in own and s not in own})
            results = sorted({v for s, t, v in flows.get(user, ()) if s in own and t not in own})
            nested = any(own < v for v in found.values())
            want.add((user, name[a[0]], name[a[1]], name[b[0]], name[b[1]], len(own), tuple(parameters), tuple(results), nested))
    rows = QUERIES["event_regions"](spark, folder).collect()
    got = {(r.owner, r.entry_src, r.entry_dst, r.exit_src, r.exit_dst, r.size, tuple(r.parameters), tuple(r.results), r.nested) for r in rows}
    assert got == want and len(rows) == len(want) > 50
