import re

import pytest

from tests.llm import fixtures
from textloom.llm import repetition


def brute(text: str) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def inside(n: int, later: bool) -> set:
        seen: dict = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + j for at in seen.values() if len(at) > 1 for i in at[later:] for j in range(n)}

    chars = sum(map(len, words))
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    dup_chars = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for k, x in enumerate(lines) if x in lines[:k])
    repeated = len(inside(3, False))
    grams = [sum(len(words[i]) for i in inside(n, True)) for n in range(5, 11)]
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    kept = not failed and dup_chars <= 0.2 * chars and all(g <= m * chars for g, m in zip(grams, repetition.MOST_IN_GRAMS.values()))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, len(lines), dup_chars, *grams, failed, kept)


def test_against_brute_force(spark):
    rows = fixtures.documents()
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    out = repetition.measure(docs, ["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[1:] == brute(r.row.text), r.row.doc_id


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], fixtures.DOCS)
    assert repetition.measure(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, kept int, `row` string")
    assert repetition.measure(odd).select("row.kept", "row.row", "kept").first() == (5, "z", False)


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query(spark, name):
    from textloom.llm.queries import QUERIES

    out = QUERIES["op9_repetition"](spark, f"/root/testdata/{name}")
    assert out.count() == spark.read.parquet(f"/root/testdata/{name}/documents.parquet").count()
