from collections import defaultdict

import pytest

from tests.llm import fixtures
from textloom.llm import lines
from textloom.llm.storage import saved


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, _, source, _ in rows:
        for n, x in enumerate((text or "").split("\n")):
            x = x.strip("\t\n\x0b\x0c\r ")
            if x:
                sites[x].add(source)
                at = (lines._LAST if i is None else i, n)
                first[x] = min(first.get(x, at), at)
    out = []
    for i, text, *_ in rows:
        kept, gone = [], 0
        for n, raw in enumerate((text or "").split("\n")):
            x = raw.strip("\t\n\x0b\x0c\r ")
            cut = bool(x) and len(sites[x]) >= min_sites and first[x] != (lines._LAST if i is None else i, n)
            gone += cut
            kept += [] if cut else [raw]
        out.append((i, "\n".join(kept), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_sites", "most"), [(3, 10**6), (2, 1), (100, 10)])
def test_against_brute_force(spark, min_sites, most):
    rows = fixtures.documents() + [(100 + k, f"own {k}\n  shared foot line \n\nvery common\n", "en", f"h{k}", 9) for k in range(30)]
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    out = lines.cut(docs, min_sites, most, carry=["doc_id"])
    assert sorted(((r.row.doc_id, r.text, len(r.cut)) for r in out.collect()), key=str) == brute(rows, min_sites)


def test_estimates_far_from_the_limit_are_right(spark):
    rows = [(k * 50 + j, f"line {k}", "en", f"site{j}", 1) for k in range(1, 60, 7) for j in range(k)]
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    assert lines.spread(docs, 20).count() == sum(k >= 20 for k in range(1, 60, 7))


def test_stage(spark):
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    out = lines.dedup(docs, 3)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert lines.dedup(docs.limit(0), 3).count() == 0


def test_parts_are_jobs_of_their_own(spark):
    """However many parts there are, a task holds one of them: the plan has one Python stage, and the result is the same."""
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    whole, dealt = lines.cut(docs, 2), lines.cut(docs, 2, most_lines=1)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))


def test_texts_are_read_once_and_never_rewritten(spark, monkeypatch):
    """However few lines may be broadcast, what is written is the tables of lines, the plan has one Python stage, and the
    result is the same; lines beyond the limit are the less frequent ones."""
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    whole = sorted(map(str, lines.cut(docs, 2).collect()))
    written = []
    monkeypatch.setattr(lines, "saved", lambda df, name: (written.append(df.columns), saved(df, name))[1])
    for most in (0, 1, 2):
        dealt = lines.cut(docs, 2, most_lines=most)
        assert dealt._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(str, dealt.collect())) == whole
    assert written and not any("text" in columns for columns in written)


def test_least_power_of_two(spark):
    found = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 3, 5, 9, 9, 1000])], "hash long, n long")
    assert [lines._hot(found, most) for most in (0, 1, 2, 3, 4, 6, 7, 100)] == [10, 4, 4, 3, 2, 1, 0, 0]


def test_many_lines_of_equal_frequency_and_clashing_names(spark):
    """None of the lines found may be broadcast, ids are null or repeated, and columns are named like those of the work."""
    columns = "doc_id long, text string, source string, id string, digest string, gone string, hash string, n string, `a.b` string"
    rows = [(None if k % 3 == 0 else k % 40, "\n".join([f"line {j}" for j in range(k % 7, 30)] + [f"own {k}"]), f"s{k % 5}", *"uvwxyz") for k in range(90)]
    docs = spark.createDataFrame(rows, columns)
    want = brute([(i, text, None, source, None) for i, text, source, *_ in rows], 3)
    for most in (0, 5, 1000):
        out = lines.cut(docs, 3, most)
        assert sorted(((r.row.doc_id, r.text, len(r.cut)) for r in out.collect()), key=str) == want
    assert lines.dedup(docs, 3).columns == docs.columns
