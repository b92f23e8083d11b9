import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures
from textloom.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def brute(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    held = [(i, Counter(terms(x))) for i, x in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    have = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * c.total() * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * have[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if empty else i, -score) for k, (score, empty, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


ITEMS = [
    (1, "Alpha1 beta2 GAMMA3 alpha1"),
    (1, "another text of the same id, alpha5"),
    (2, None),
    (3, " ,;- "),
    (4, "nothing_there zzzz"),
    (5, "ünï cödé 日本 One five"),
    (None, "one two three same line"),
    (6, fixtures.prose(1, 120)),
    (6, fixtures.prose(1, 120)),
    (7, "x" * 3000),
    (8, "id here"),
]


@pytest.mark.parametrize("most_bytes", [900, 1 << 22])
def test_against_brute_force(spark, most_bytes):
    rows = fixtures.documents() + [(200 + k, "tied words here", None, None, 0) for k in range(30)]
    docs = spark.createDataFrame(rows, fixtures.DOCS).repartition(5)
    items = spark.createDataFrame(ITEMS + [(9, "tied tied")], "item_id long, text string")
    found = ranking.search(docs, items, most_bytes=most_bytes).collect()
    assert key(found) == key(brute([r[:2] for r in rows], ITEMS + [(9, "tied tied")], ranking.TOP))
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"]) if r.item_id == 9] == list(range(200, 220))


def test_blocks_of_documents_do_not_matter(spark):
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = key(ranking.search(docs.coalesce(1), items, top=3).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert key(ranking.search(docs.coalesce(1), items, top=3).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame(fixtures.documents(), fixtures.DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs.where("doc_id in (16, 17, 18)"), items).count() == 0
    odd = spark.createDataFrame([(1, "a b", 2, 3, "z", 4)], "doc_id long, text string, size int, item int, `a.b` string, rank int")
    asked = spark.createDataFrame([("i1", "A c", 1)], "item_id string, text string, doc_id int")
    assert [tuple(r) for r in ranking.search(odd, asked).collect()] == [tuple(r) for r in brute([(1, "a b")], [("i1", "A c")], 20)]


def test_sizes_beyond_64_bits():
    size = np.array([4 * 10**9, 10], np.int64)
    got = ranking.impacts(size, np.array([0, 1]), np.array([0, 0]), np.array([3, 1]), np.array([700]), 10**11, 5 * 10**12)
    assert got.tolist() == [700 * (10**9 * t // (1000 * t + 12 * (75 + 25 * int(s) * 10**11 // (5 * 10**12)))) for s, t in zip(size, (3, 1))]
