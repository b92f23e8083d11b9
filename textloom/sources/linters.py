"""Reports of four external linters in their own JSON shapes, as findings by our rules.

``reports`` are (tool, path, report): what one run of a tool printed about one source. clj-kondo gives one object with
``findings``; clippy gives lines of objects, of which compiler messages count; StaticLint and JET give one object with
``diagnostics``, whose rule may be called code, kind or lint and whose line may be called row.

Cases: codes without a rule of ours give nothing, but what StaticLint calls nothing of ours is judged by its message;
a missing line is 1, as is a line 0 but clippy's; a missing message is made from the code or rule; a report that is
malformed anywhere (odd JSON, fields of another type, a clj-kondo finding without a type) gives no finding, and
``malformed`` names it; a null report, tool or path and an unknown tool give nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rules that the tools' codes stand for, and what we say of them
KONDO = {"unused-binding": "unused-binding", "unused-private-var": "unused-private-def", "unused-namespace": "unused-namespace", "redundant-do": "redundant-do"}
CLIPPY = {"needless_return": "needless-return", "redundant_clone": "needless-clone", "let_and_return": "let-and-return", "useless_format": "useless-format", "redundant_closure": "redundant-closure"}
STATICLINT = {
    "unused-arg": "unused-arg", "unused-argument": "unused-arg", "unused-function-argument": "unused-arg",
    "unused-binding": "unused-binding", "unused-variable": "unused-binding", "unused-local": "unused-binding", "unused-var": "unused-binding",
    "missing-reference": "missing-reference", "undefined-var": "missing-reference", "undefined-variable": "missing-reference", "unresolved-reference": "missing-reference",
}
SUGGESTIONS = {
    "clj-kondo": {
        "unused-binding": "remove or inline the unused binding after semantic review",
        "unused-private-def": "remove the private var only after project tests pass",
        "unused-namespace": "remove the unused namespace require/import",
        "redundant-do": "drop the inner do; clj-kondo confirmed it is redundant",
    },
    "clippy": {
        "needless-return": "remove the tail-position return after checks pass",
        "needless-clone": "remove clone only when borrow/lifetime checks pass",
        "let-and-return": "return the expression directly after checks pass",
        "useless-format": "use to_string when type semantics are acceptable",
        "redundant-closure": "use the function directly when inference remains valid",
    },
    "staticlint": {
        "unused-arg": "remove or inline the unused argument after semantic review",
        "unused-binding": "remove or inline the unused binding after semantic review",
        "missing-reference": "review the unresolved reference; this is report-only",
    },
    "jet": {"julia-jet": "review JET report; correctness diagnostics are report-only"},
}
#: Rules that are only ever reported; the tool confirms the others.
REPORT_ONLY = ("missing-reference", "julia-jet")

_BAD = "bad string"
_DIAGNOSTICS = "diagnostics array<struct<rule string, code string, kind string, lint string, line long, row long, message string>>"
SHAPES = {
    "clj-kondo": f"findings array<struct<type string, row long, message string>>, {_BAD}",
    "clippy": f"reason string, message struct<code struct<code string>, spans array<struct<line_start long>>, message string>, {_BAD}",
    "staticlint": f"{_DIAGNOSTICS}, {_BAD}",
    "jet": f"{_DIAGNOSTICS}, {_BAD}",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _parsed(reports: DataFrame, tool: str) -> DataFrame:
    """path, place (of a line within the report), j (the shape), wrong."""
    rows = reports.where((F.col("tool") == tool) & F.col("report").isNotNull() & F.col("path").isNotNull())
    text = F.split("report", "\r?\n") if tool == "clippy" else F.array("report")
    rows = rows.select("path", "report", F.posexplode(text).alias("place", "line"))
    if tool == "clippy":
        rows = rows.where(F.trim("line") != "")
    rows = rows.select("path", "report", "place", F.from_json("line", SHAPES[tool], {"columnNameOfCorruptRecord": "bad"}).alias("j"))
    wrong = F.col("j").isNull() | F.col("j.bad").isNotNull()
    if tool == "clj-kondo":
        wrong |= F.coalesce(F.exists("j.findings", lambda x: x["type"].isNull() | (x["row"] < 0)), F.lit(False))
    elif tool != "clippy":
        wrong |= F.coalesce(F.exists("j.diagnostics", lambda x: F.least(x["line"], x["row"]) < 0), F.lit(False))
    return rows.withColumn("wrong", wrong)


def malformed(reports: DataFrame) -> DataFrame:
    """tool, path, line: the first place where a report is not of its tool's shape."""
    parts = [_parsed(reports, tool).where("wrong").groupBy("path", "report").agg((F.min("place") + 1).alias("line")).select(F.lit(tool).alias("tool"), "path", "line") for tool in SHAPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def findings(reports: DataFrame) -> DataFrame:
    """tool, path, line, rule, severity, safety, message, suggestion of all reports."""
    out = []
    for tool in SHAPES:
        rows = _parsed(reports, tool)
        if tool == "clippy":  # the one shape of many lines: one wrong line spoils its report
            bad = rows.where("wrong").select("path", "report").distinct()
            rows = rows.join(bad, ["path", "report"], "left_anti")
        rows = rows.where("NOT wrong")
        if tool == "clj-kondo":
            rows = rows.select("path", F.explode("j.findings").alias("f")).select("path", "f.row", F.col("f.type").alias("code"), "f.message")
            rows = rows.select("path", F.greatest(F.coalesce("row", F.lit(1)), F.lit(1)).alias("line"), _looked_up(KONDO, F.col("code")).alias("rule"), F.coalesce("message", F.concat(F.lit("clj-kondo reported "), "code")).alias("message"))
        elif tool == "clippy":
            rows = rows.where("j.reason = 'compiler-message'").select("path", "j.message.*")
            rule = _looked_up(CLIPPY, F.regexp_replace("code.code", "^clippy::", ""))
            first = F.get("spans", F.lit(0))["line_start"]
            rows = rows.select("path", F.when(first >= 0, first).otherwise(1).alias("line"), rule.alias("rule"), F.coalesce("message", rule).alias("message"))
        else:
            rows = rows.select("path", F.explode("j.diagnostics").alias("f")).select("path", F.greatest(F.coalesce("f.line", "f.row", F.lit(1)), F.lit(1)).alias("line"), F.coalesce("f.rule", "f.code", "f.kind", "f.lint", F.lit("")).alias("code"), "f.message")
            if tool == "jet":
                rows = rows.select("path", "line", F.lit("julia-jet").alias("rule"), F.coalesce("message", F.lit("JET reported a possible Julia issue")).alias("message"))
            else:
                low = F.lower("message")
                unused = F.when(low.contains("unused") & low.contains("argument"), "unused-arg").when(low.contains("unused"), "unused-binding")
                by_message = unused.when(low.contains("missing reference") | low.contains("undefined") | low.contains("unresolved"), "missing-reference")
                rule = F.coalesce(_looked_up(STATICLINT, F.translate(F.lower(F.trim("code")), "_ ", "--")), by_message)
                rows = rows.select("path", "line", rule.alias("rule"), F.coalesce("message", F.concat(F.lit("StaticLint reported "), rule)).alias("message"))
        safety = F.when(F.col("rule").isin(*REPORT_ONLY), "never-auto").otherwise("analyzer-confirmed")
        rows = rows.where("rule IS NOT NULL").select(F.lit(tool).alias("tool"), "path", F.col("line").cast("long").alias("line"), "rule", F.lit("minor").alias("severity"), safety.alias("safety"), "message", _looked_up(SUGGESTIONS[tool], F.col("rule")).alias("suggestion"))
        out.append(rows)
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def redundant_do_edits(found: DataFrame, sources: DataFrame) -> DataFrame:
    """path, line, start_byte, end_byte: what clj-kondo's ``redundant-do`` findings take out of the sources (path, text): the
    last closing bracket of the line and its first ``(do `` with the space. Lines that have not both in that order have none."""
    rows = found.where("tool = 'clj-kondo' AND rule = 'redundant-do'").select("path", "line").distinct()
    rows = rows.join(sources.select("path", F.split("text", "\n").alias("lines")), "path").where(F.col("line") <= F.size("lines"))
    before = F.array_join(F.slice("lines", F.lit(1), (F.col("line") - 1).cast("int")), "\n")
    start = F.octet_length(before) + F.when(F.col("line") > 1, 1).otherwise(0)
    rows = rows.select("path", "line", start.cast("long").alias("at"), F.get("lines", (F.col("line") - 1).cast("int")).alias("body")).where(F.col("body").contains("(do ") & F.col("body").contains(")"))
    do = F.octet_length(F.substring_index("body", "(do ", 1))
    close = F.octet_length("body") - 1 - F.octet_length(F.substring_index("body", ")", -1))
    rows = rows.select("path", "line", (F.col("at") + do).alias("do"), (F.col("at") + close).alias("close")).where("close > do")
    spans = F.array(F.struct(F.col("close").alias("start_byte"), (F.col("close") + 1).alias("end_byte")), F.struct(F.col("do").alias("start_byte"), (F.col("do") + 4).alias("end_byte")))
    return rows.select("path", "line", F.inline(spans))
