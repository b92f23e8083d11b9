import random
import re

import numpy as np

from tests.llm import fixtures
from textloom.llm import neardup


def sets_of(rows):
    out = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            same = i is not None and i == j
            if same or (a and b and 100 * len(a & b) >= 85 * len(a | b)):
                up[root(x)] = root(y)
    out = []
    for x, (i, a) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if root(y) == root(x) and sets[y][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(a), least, i == least))
    return sorted(out, key=str)


def rows_with_groups():
    draw = random.Random(11)
    rows = fixtures.documents()
    at = 100
    for g in range(12):  # chains and stars of near copies, many about the threshold
        base = fixtures.prose(1000 + g, draw.choice([30, 80, 200, 400])).split()
        for _ in range(draw.choice([3, 9, 20])):
            words = list(base)
            for _ in range(draw.randrange(0, max(2, len(words) // 40))):
                words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
            rows.append((at, " ".join(words), "en", "s", 1))
            at += 1
            if draw.random() < 0.3:
                base = words
    return rows


def test_against_brute_force(spark):
    rows = rows_with_groups()
    out = neardup.grouped(spark.createDataFrame(rows, fixtures.DOCS))
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_shared_passage_makes_no_links(spark):
    """Many documents in the same buckets, none of them near copies, and a few that are."""
    passage = fixtures.prose(4, 60)
    rows = [(k, f"{fixtures.prose(2000 + k, 18)} {passage} {fixtures.prose(3000 + k, 8)}", "en", "s", 1) for k in range(150)]
    rows += [(500 + k, rows[3 * k][1] + " tail", "en", "s", 1) for k in range(20)]
    out = neardup.grouped(spark.createDataFrame(rows, fixtures.DOCS))
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_estimate_and_merge():
    draw = np.random.default_rng(3)
    for wanted in (0.2, 0.5, 0.85, 0.95):
        n = 4000
        both = int(2 * n * wanted / (1 + wanted))
        pool = draw.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = pool[:n], pool[n - both :]
        regs = neardup.registers(np.concatenate((a, b)), np.array([0, n, 2 * n]))
        got = neardup.estimated(regs[:1], regs[1:], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - wanted) < 0.13
        union = neardup.registers(pool, np.array([0, len(pool)]))
        assert (union == np.maximum(regs[:1], regs[1:])).all()


def test_stage_and_empty(spark):
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    out = neardup.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _, least, kept in brute(fixtures.documents()) if kept}
    assert neardup.grouped(docs.limit(0)).count() == 0


def linked_at(rows, percent):
    """The smallest id of each id's component, by brute force at another threshold."""
    sets, up = sets_of(rows), {i: i for i, *_ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return {i: root(i) for i, _ in sets}


def test_another_threshold(spark):
    """A hundred words with two of them changed: 86 of 106 shingles."""
    rows = []
    for g in range(40):
        words = fixtures.prose(5000 + g, 100).split()
        rows.append((2 * g, " ".join(words), "en", "s", 1))
        words[20], words[60] = "changed", "too"
        if g % 4 == 3:
            words[90:95] = ["one", "more"]  # below 0.8
        rows.append((2 * g + 1, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    at_80, at_85 = linked_at(rows, 80), linked_at(rows, 85)
    assert len(set(at_80.values())) == 50 and len(set(at_85.values())) == 80
    assert {r.doc_id: r.component_id for r in neardup.grouped(docs, (80, 100)).collect()} == at_80
    assert {r.doc_id: r.component_id for r in neardup.grouped(docs, (85, 100)).collect()} == at_85
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == set(at_80.values())


def test_bands_find_pairs_at_the_threshold():
    assert neardup.bands_and_rows((85, 100)) == (20, 5) and neardup.bands_and_rows((80, 100)) == (25, 4)
    for t in ((70, 100), (80, 100), (85, 100), (95, 100)):
        bands, rows = neardup.bands_and_rows(t)
        assert bands * rows == neardup.REGISTERS and (1 - (t[0] / t[1]) ** rows) ** bands <= neardup.MISSED


def test_hot_buckets_are_split_by_rare_shingles(spark, monkeypatch):
    """Every bucket split, as those of a template that many fill in would be: the same links."""
    monkeypatch.setattr(neardup, "MOST_COPIES", 0)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    template, rows = fixtures.prose(77, 90).split(), rows_with_groups()
    for k in range(60):  # one template, of which a few are nearly the same
        own = fixtures.prose(3000 + (k // 3 if k < 12 else k), 12).split()
        words = template[:40] + own + template[40:]
        words[k % 30] = f"x{k}" if k % 3 else words[k % 30]
        rows.append((9000 + k, " ".join(words), "en", "s", 1))
    out = neardup.grouped(spark.createDataFrame(rows, fixtures.DOCS))
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_linked_sets_share_a_rare_shingle():
    draw = np.random.Generator(np.random.PCG64(5))
    counts = draw.integers(0, 50, neardup.SLOTS)
    for _ in range(300):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 1 << 60, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[draw.random(len(a)) > 0.1], draw.integers(0, 1 << 60, int(draw.integers(0, 4)), dtype=np.uint64))))
        for t in ((85, 100), (80, 100)):
            if len(b) and neardup.linked(len(np.intersect1d(a, b)), len(a), len(b), t):
                assert len(np.intersect1d(neardup.rare_first(a, counts, t), neardup.rare_first(b, counts, t)))
