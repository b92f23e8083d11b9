"""Records: masks, guards, coverage, revisions, caches and captures, by small cases."""

import json
import random

import pytest

from textloom.operators import records

STATES = "code quote line block".split()


def by_states(text):
    """Strings and comments as blanks, one character after another."""
    out, state, quote, k = [], "code", "", 0
    while k < len(text):
        c, two = text[k], text[k : k + 2]
        blank = "\n" if c == "\n" else " "
        if state == "code":
            if c == "#" or two == "//":
                state = "line"
            elif two == "/*":
                state = "block"
                out.append(" ")
                k += 1
            elif c in "'\"`":
                state, quote = "quote", c
            out.append(c if state == "code" else " ")
        elif state == "quote":
            out.append(blank)
            if c == "\\" and k + 1 < len(text):
                k += 1
                out.append("\n" if text[k] == "\n" else " ")
                state = "code" if text[k] == "\n" and quote != "`" else state
            elif c == quote or c == "\n" and quote != "`":
                state = "code"
        elif state == "line":
            out.append(blank)
            if c == "\n":
                state = "code"
        else:
            out.append(blank)
            if two == "*/":
                out.append(" ")
                k += 1
                state = "code"
        k += 1
    return "".join(out)


def test_masks():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "1", " ", "\n", "'", '"', "`", "#", "/", "*", "\\", "//", "/*", "*/"]) for _ in range(draw.randrange(0, 30)))
        assert records.masked(text) == by_states(text), text
    assert records.masked("x = 'a # b' # c\ny") == "x =           " + " " + "\ny"


def test_guards(spark):
    rows = [("a", "if x_rate == 0 || isNaN(y) {\n raise(e)\n}"), ("b", "s = 'isNaN( == 0'\n"), ("c", "if (minSize > 0 && isfinite(v)) {}\n" + "\n" * 9 + "if isnan(w) {}"), ("d", None), ("e", " ".join(f"name_{k:03d}" for k in range(200)))]
    out = {r.path: r for r in records.guard_facts(spark.createDataFrame(rows, "path string, text string"), "path").collect()}
    assert out["a"].fail_loud and set(out["a"].features) == {"nan", "zero", "nan-or-zero"} and out["a"].predicate_identifiers == ["x_rate"]
    assert out["b"].features == [] and not out["b"].fail_loud and set(out["c"].features) == {"finite", "positive", "nan"}
    assert out["c"].identifiers == ["minSize"] and out["e"].identifiers == [f"name_{k:03d}" for k in range(96)] and out["d"].features in (None, [])


def test_guards_make_the_compact_text_once(spark):
    df = records.guard_facts(spark.createDataFrame([("a", "x")], "path string, text string"), "path")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 4  # of the whole text, of lines, and two of windows


def test_utf16(spark):
    text = "a😀é\nb😀c"
    from pyspark.sql import functions as F

    raw = text.encode()
    cuts = [len(text[:k].encode()) for k in range(len(text) + 1)]
    df = spark.createDataFrame([(text, k) for k in cuts], "text string, k long")
    line, col = records.utf16_column(F.col("text"), F.col("k"))
    got = sorted((r.k, r.line, r.col) for r in df.select("k", line.alias("line"), col.alias("col")).collect())
    want = sorted((k, raw[:k].count(b"\n"), len(raw[:k].decode().rsplit("\n", 1)[-1].encode("utf-16-le")) // 2) for k in cuts)
    assert got == want


def test_coverage_modes(spark):
    report = json.dumps({"files": {"a.py": {"executed_lines": [1, 2], "missing_lines": [5]}}})
    one = spark.createDataFrame([(report,)], "value string")
    for mode in ("auto", "coverage-py"):
        assert sorted(map(tuple, records.coverage(mode, one).collect())) == [("a.py", 1, 1), ("a.py", 2, 1), ("a.py", 5, 0)]
    jl = spark.createDataFrame([("m.jl.123.cov", "        - function f()\n        4   x\n        0   y\n        - end"), ("m.jl.99.cov", "        - \n        1 x")], "path string, value string")
    assert sorted(map(tuple, records.coverage("julia-cov", jl).collect())) == [("m.jl", 2, 5), ("m.jl", 3, 0)]
    lcov = spark.createDataFrame([("r", 0, "SF:a"), ("r", 1, "DA:3,2"), ("r", 2, "end_of_record")], "report string, pos long, value string")
    assert [tuple(r) for r in records.coverage("auto", lcov).collect()] == [tuple(r) for r in records.coverage("cloverage", lcov).collect()] == [("a", 3, 2)]
    with pytest.raises(ValueError):
        records.coverage("other", one)


def test_revisions_history_and_manifests(spark, tmp_path):
    for rev, text in (("r1", "x = 1\n"), ("r%2F2", "x = 2\n")):
        (tmp_path / f"revision={rev}" / "pkg").mkdir(parents=True)
        (tmp_path / f"revision={rev}" / "pkg" / "a.py").write_text(text)
    (tmp_path / "other.txt").write_text("no")
    assert sorted(map(tuple, records.revisions(spark, str(tmp_path)).collect())) in ([("pkg/a.py", "x = 1\n", "r1"), ("pkg/a.py", "x = 2\n", "r%2F2")], [("pkg/a.py", "x = 1\n", "r1"), ("pkg/a.py", "x = 2\n", "r/2")])
    bundle = {"id": "h", "revisions": [{"ix": 0, "files": [{"path": "a", "text": "t"}], "facts": []}, {"ix": 1, "files": [], "facts": [{"path": "a", "name": "f", "verdict": "moved"}]}]}
    files, facts = records.history(spark.createDataFrame([(json.dumps(bundle),)], "value string"))
    assert [tuple(r) for r in files.collect()] == [("h", 0, "a", "t")] and [tuple(r) for r in facts.collect()] == [("h", 1, "a", "f", "moved")]
    with pytest.raises(Exception):
        records.history(spark.createDataFrame([("{",)], "value string"))[0].collect()
    cases = {"cases": [{"path": "a", "lang": "python", "expectations": [{"rule": "x", "line": 1, "should_fire": True}, {"rule": "y", "line": 2, "should_fire": True}]}]}
    m = records.manifest(spark.createDataFrame([(json.dumps(cases),)], "value string"))
    told = spark.createDataFrame([("a", "python", "x", 1), ("b", "rust", "z", 4), ("b", "rust", "z", 4)], "path string, lang string, rule string, line int")
    assert sorted(map(tuple, records.with_feedback(m, told).collect())) == [("a", "python", "x", 1, False), ("a", "python", "y", 2, True), ("b", "rust", "z", 4, False)]


def test_cache_and_captures(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "key string, payload string")
    cache = str(tmp_path / "cache")
    assert records.put(cache, rows(("a", "1"), ("b", "2"), ("a", "1"))) == 2 and records.put(cache, rows(("a", "1"), ("c", "3"))) == 1
    for bad in (rows(("a", "9"), ("d", "4")), rows(("e", "1"), ("e", "2"))):
        with pytest.raises(ValueError):
            records.put(cache, bad)
    assert sorted(map(tuple, spark.read.parquet(cache).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    snap, versions = spark.range(50).selectExpr("id", "id % 7 AS x"), {"rules": "1", "trees": "2"}
    name = records.capture(snap, str(tmp_path / "s"), versions)
    assert name == records.capture(snap.repartition(5), str(tmp_path / "s"), versions) and name != records.capture(snap.limit(49), str(tmp_path / "s"), versions)
    assert records.restore(spark, str(tmp_path / "s"), name, versions).count() == 50
    with pytest.raises(ValueError):
        records.restore(spark, str(tmp_path / "s"), name, versions | {"rules": "2"})


def test_commit_digest_does_not_see_how_rows_are_dealt(spark):
    docs = spark.range(500).selectExpr("id", "id % 3 AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'x' END AS t").union(spark.range(3).selectExpr("0", "0", "NULL"))
    found = {tuple(records.commit_digest(d, ["id"]).first()) for d in (docs, docs.repartition(7), docs.orderBy("k").coalesce(1))}
    assert len(found) == 1 and next(iter(found))[0] == 503
    assert records.commit_digest(docs.where("id <> 7"), ["id"]).first().digest != next(iter(found))[1]
