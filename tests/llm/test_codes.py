import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import codes


def brute(rows: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = sorted((r for r in rows if fine(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1])
    ints = [[math.floor(256 * min(65536, max(-65536, x))) for x in v] if len(v) == size else None for _, v, _ in kept]
    at = [size * k // parts for k in range(parts + 1)]
    full = [v for v in ints if v is not None]
    books = [[v[a:b] for v in full[:entries]] for a, b in zip(at, at[1:])]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(at, at[1:])):
            groups: dict = {}
            for v in full:
                groups.setdefault(nearest(v[a:b], books[k])[1], []).append(v[a:b])
            for e, g in groups.items():
                books[k][e] = [sum(x) // len(g) for x in zip(*g)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, by = [], {}
    for (i, _, label), v in zip(kept, ints):
        found = None if v is None else [nearest(v[a:b], book) for book, (a, b) in zip(books, zip(at, at[1:]))]
        error = None if found is None else sum(f for f, _ in found)
        out.append((i, None if found is None else "".join(f"{e:02x}" for _, e in found), error, label))
        if error is not None:
            by[label] = by.get(label, 0) + error
    return [(i, code, error, by.get(label), digest) for i, code, error, label in out]


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def vectors(seed: int, n: int, size: int, coarse: bool) -> list[tuple]:
    """Coarse values give many equal distances and equal vectors."""
    draw = random.Random(seed)
    value = (lambda: draw.randrange(-3, 4) / 256) if coarse else (lambda: draw.uniform(-1, 1))
    rows = [(k, [value() for _ in range(size)], draw.choice([None, 1, 1, 1, 2])) for k in range(n)]
    odd = [(n, None, 1), (n + 1, [None, *[0.1] * (size - 1)], 1), (n + 2, [float("nan"), *[0.1] * (size - 1)], 2), (n + 3, [math.inf] * size, 2), (n + 4, [0.5] * (size + 1), 3), (None, [0.25] * size, None), (n + 5, [1e30] + [-1e30] * (size - 1), 4), rows[0], rows[1]]
    return rows + odd


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("size", "coarse"), [(32, True), (32, False), (20, True)])
def test_against_brute_force(spark, size, coarse):
    rows = vectors(size, 300, size, coarse)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert key(got) == key(brute(rows, 16, 64, 2))


@pytest.mark.parametrize("seed", range(12))
def test_filtering_equals_all_distances(seed, monkeypatch):
    """Codes, sums and counts, ties by the lower index, with leaves and blocks of several sizes."""
    monkeypatch.setattr(codes, "LEAF", [1, 3, 12][seed % 3])
    monkeypatch.setattr(codes, "MOST_NUMBERS", [64, 1 << 21][seed % 2])
    draw = np.random.default_rng(seed)
    points = draw.integers(-4 if seed % 2 else -900, 5 if seed % 2 else 900, (int(draw.integers(1, 700)), int(draw.integers(1, 6))))
    entries = points[draw.integers(0, len(points), int(draw.integers(1, 40)))]
    far = ((points[:, None, :] - entries) ** 2).sum(2)
    code, sums, counts = codes.assigned(points, entries, False)
    assert (code == far.argmin(1)).all()
    assert (counts == np.bincount(far.argmin(1), minlength=len(entries))).all()
    assert all((sums[e] == points[far.argmin(1) == e].sum(0)).all() for e in range(len(entries)))
    assert codes.assigned(points, entries, True)[0] is None


def test_most_subtrees_are_assigned_as_a_whole(monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.integers(-5000, 5000, (16, 4))
    points = centres[draw.integers(0, 16, 4000)] + draw.integers(-40, 40, (4000, 4))
    seen = []
    places = codes._places
    monkeypatch.setattr(codes, "_places", lambda bounds, nodes: seen.append(places(bounds, nodes)) or seen[-1])
    codes.assigned(points, centres, True)  # only leaves ask for their places
    assert sum(map(len, seen)) < 400


def test_labels_beyond_the_limit_are_joined_alike(spark):
    coded = spark.createDataFrame([(k, None if k % 3 == 0 else k % 5, f"{k:02x}", k) for k in range(60)], "vec_id long, label int, code string, error long")
    labels = coded.groupBy("label").sum("error").withColumnRenamed("sum(error)", "label_error")
    assert key(codes._with_sums(coded, labels, 0, 4).select("vec_id", "label_error").collect()) == key(codes._with_sums(coded, labels, 100).select("vec_id", "label_error").collect())


def test_cases(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], SCHEMA)).count() == 0
    few = [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (3, [], 1)]
    assert key(codes.compress(spark.createDataFrame(few, SCHEMA)).collect()) == key(brute(few, 16, 64, 2))
    none = [(1, [], 1), (2, [], 1)]
    assert key(codes.compress(spark.createDataFrame(none, SCHEMA)).collect()) == key(brute(none, 16, 64, 2))
    odd = spark.createDataFrame([(1, [0.5] * 16, 1, "a", "b", "c", 5)], SCHEMA + ", code string, `row` string, `a.b` string, error int")
    assert key(codes.compress(odd).collect()) == key(brute([(1, [0.5] * 16, 1)], 16, 64, 2))
