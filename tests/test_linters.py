"""External linters' reports in their own shapes."""

import json

from textloom.sources import linters

REPORTS = [
    ("clj-kondo", "a.clj", json.dumps({"findings": [{"type": "unused-binding", "row": 3, "col": 1, "message": "unused x", "filename": "a.clj"}, {"type": "odd", "row": 1}, {"type": "redundant-do", "row": 0}, {"type": "unused-private-var"}], "summary": {"error": 0}})),
    ("clj-kondo", "b.clj", "{}"),
    ("clj-kondo", "c.clj", '{"findings": [{"type": "unused-binding", "row": 1}, {"row": 2}]}'),
    ("clj-kondo", "d.clj", '{"findings": [{"type": "unused-binding", "row": -1}]}'),
    ("clippy", "a.rs", "\n".join([
        json.dumps({"reason": "compiler-artifact"}), "  ",
        json.dumps({"reason": "compiler-message", "message": {"code": {"code": "clippy::needless_return", "explanation": None}, "spans": [{"line_start": 7, "line_end": 9}, {"line_start": 1}], "message": "unneeded return"}}),
        json.dumps({"reason": "compiler-message", "message": {"code": {"code": "redundant_clone"}, "spans": []}}),
        json.dumps({"reason": "compiler-message", "message": {"code": None, "spans": [], "message": "3 warnings"}}),
        json.dumps({"reason": "build-finished", "success": True})])),
    ("clippy", "b.rs", json.dumps({"reason": "compiler-message", "message": {"code": {"code": "let_and_return"}, "spans": [{"line_start": 2}]}}) + "\nwarning: no JSON"),
    ("staticlint", "a.jl", json.dumps({"diagnostics": [{"rule": "Unused Argument", "line": 2}, {"code": "undefined_var", "row": 5, "message": "m"}, {"kind": "X", "message": "This argument is UNUSED"}, {"lint": "X", "message": "Unused"}, {"message": "unresolved"}, {"rule": "X", "message": "fine"}, {"rule": "X"}]})),
    ("jet", "b.jl", json.dumps({"diagnostics": [{"message": "no method", "line": 4}, {}]})),
    ("jet", "c.jl", '{"diagnostics": [{"line": "four"}]}'),
    ("other", "x", "{}"), ("jet", None, "{}"), ("jet", "x", None), (None, "x", "{}"),
]


def test_shapes(spark):
    reports = spark.createDataFrame(REPORTS, "tool string, path string, report string")
    got = sorted((r.tool, r.path, r.line, r.rule, r.safety, r.message) for r in linters.findings(reports).collect())
    assert got == sorted([
        ("clj-kondo", "a.clj", 3, "unused-binding", "analyzer-confirmed", "unused x"),
        ("clj-kondo", "a.clj", 1, "redundant-do", "analyzer-confirmed", "clj-kondo reported redundant-do"),
        ("clj-kondo", "a.clj", 1, "unused-private-def", "analyzer-confirmed", "clj-kondo reported unused-private-var"),
        ("clippy", "a.rs", 7, "needless-return", "analyzer-confirmed", "unneeded return"),
        ("clippy", "a.rs", 1, "needless-clone", "analyzer-confirmed", "needless-clone"),
        ("staticlint", "a.jl", 2, "unused-arg", "analyzer-confirmed", "StaticLint reported unused-arg"),
        ("staticlint", "a.jl", 5, "missing-reference", "never-auto", "m"),
        ("staticlint", "a.jl", 1, "unused-arg", "analyzer-confirmed", "This argument is UNUSED"),
        ("staticlint", "a.jl", 1, "unused-binding", "analyzer-confirmed", "Unused"),
        ("staticlint", "a.jl", 1, "missing-reference", "never-auto", "unresolved"),
        ("jet", "b.jl", 4, "julia-jet", "never-auto", "no method"),
        ("jet", "b.jl", 1, "julia-jet", "never-auto", "JET reported a possible Julia issue"),
    ])
    assert all(r.suggestion for r in linters.findings(reports).collect())
    assert sorted((r.tool, r.path, r.line) for r in linters.malformed(reports).collect()) == [("clippy", "b.rs", 2), ("clj-kondo", "c.clj", 1), ("clj-kondo", "d.clj", 1), ("jet", "c.jl", 1)]
    assert linters.findings(reports.limit(0)).count() == 0 and linters.malformed(reports.limit(0)).count() == 0


def test_redundant_do(spark):
    text = "(ns ä)\n(when é (do (f) (g)))\n) (do \n(do x)"
    found = spark.createDataFrame([("clj-kondo", "a", k, "redundant-do") for k in (1, 2, 2, 3, 4, 9)] + [("clj-kondo", "a", 4, "unused-binding")], "tool string, path string, line long, rule string")
    edits = linters.redundant_do_edits(found, spark.createDataFrame([("a", text), ("b", None)], "path string, text string"))
    data = text.encode()
    for start, end in sorted(((r.start_byte, r.end_byte) for r in edits.collect()), reverse=True):
        data = data[:start] + data[end:]
    assert data.decode() == "(ns ä)\n(when é (f) (g))\n) (do \nx"
