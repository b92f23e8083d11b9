"""Queries of external linters' reports. Each event stands for a run of the tool that its user is assigned to: its type is the
code, its props' number the line, and the report is written in the tool's own shape before it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import query, table
from textloom.sources import linters

_CODES = [
    ("clj-kondo", {"click": "unused-binding", "purchase": "unused-private-var", "error": "unused-namespace", "signup": "redundant-do", "view": "unresolved-symbol"}),
    ("clippy", {"click": "clippy::needless_return", "purchase": "redundant_clone", "error": "clippy::useless_format", "signup": "clippy::redundant_closure", "view": "clippy::unwrap_used"}),
    ("staticlint", {"click": "Unused_Argument", "purchase": "E1", "error": " undefined var", "signup": "E2", "view": "E3"}),
    ("jet", {"click": "a", "purchase": "b", "error": "c", "signup": "d", "view": "e"}),
]


def _reports(spark, d):
    """tool, path, report. Numbers that 5 divides have no message, but for the two types that StaticLint tells by theirs; numbers
    that 7 divides have no line; those that 11 divides have a report cut short."""
    events = table(spark, d, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.pmod("user_id", F.lit(4))
    rows = events.select("event_type", F.concat(F.lit("src/"), "event_id").alias("path"), k.alias("k"), kind.alias("kind")).where("k IS NOT NULL")
    line = F.when(F.col("k") % 7 != 0, F.col("k"))
    told = F.when(F.col("event_type") == "purchase", "Unused name").when(F.col("event_type") == "signup", "UNRESOLVED name")
    message = F.when((F.col("kind") == 2) & told.isNotNull(), told).when(F.col("k") % 5 != 0, F.concat(F.lit("no. "), "k"))
    codes = [F.coalesce(*[F.when(F.col("event_type") == t, c) for t, c in of.items()], F.lit("other")) for _, of in _CODES]
    kondo = F.to_json(F.struct(F.array(F.struct(codes[0].alias("type"), line.alias("row"), message.alias("message"), F.lit("x").alias("level"))).alias("findings")))
    inner = F.struct(F.struct(codes[1].alias("code")).alias("code"), F.array(F.struct(line.alias("line_start"))).alias("spans"), message.alias("message"))
    clippy = F.concat_ws("\n", F.lit('{"reason":"build-script-executed"}'), F.to_json(F.struct(F.lit("compiler-message").alias("reason"), inner.alias("message"))), F.lit(""))
    julia = lambda code, rule, at: F.to_json(F.struct(F.array(F.struct(code.alias(rule), line.alias(at), message.alias("message"))).alias("diagnostics")))
    report = F.element_at(F.array(kondo, clippy, julia(codes[2], "lint", "row"), julia(codes[3], "kind", "line")), (F.col("kind") + 1).cast("int"))
    cut = F.when(F.col("k") % 11 == 0, F.substring(report, F.lit(1), F.length(F.rtrim(report)) - 2)).otherwise(report)
    tool = F.element_at(F.array(*[F.lit(name) for name, _ in _CODES]), (F.col("kind") + 1).cast("int"))
    return rows.select(tool.alias("tool"), "path", cut.alias("report"))


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


_RULES = [
    {"click": "unused-binding", "purchase": "unused-private-def", "error": "unused-namespace", "signup": "redundant-do"},
    {"click": "needless-return", "purchase": "needless-clone", "error": "useless-format", "signup": "redundant-closure"},
    {"click": "unused-arg", "purchase": "unused-binding", "error": "missing-reference", "signup": "missing-reference"},
]
_RUNS = """e AS (SELECT event_type AS t, 'src/' || event_id AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 4 AS kind
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL)"""
_SUGGESTED = " ".join(f"WHEN tool = '{tool}' AND rule = '{rule}' THEN '{words}'" for tool, of in linters.SUGGESTIONS.items() for rule, words in of.items())


@query("linter_reports", f"""WITH {_RUNS},
r AS (SELECT *, CASE kind WHEN 0 THEN 'clj-kondo' WHEN 1 THEN 'clippy' WHEN 2 THEN 'staticlint' ELSE 'jet' END AS tool,
  CASE kind WHEN 0 THEN {_case('t', _RULES[0])} WHEN 1 THEN {_case('t', _RULES[1])} WHEN 2 THEN {_case('t', _RULES[2])} ELSE 'julia-jet' END AS rule FROM e WHERE k % 11 <> 0)
SELECT tool, path, CASE WHEN k % 7 = 0 THEN 1 ELSE k END AS line, rule, 'minor' AS severity,
  CASE WHEN rule IN ('missing-reference', 'julia-jet') THEN 'never-auto' ELSE 'analyzer-confirmed' END AS safety,
  CASE WHEN kind = 2 AND t = 'purchase' THEN 'Unused name' WHEN kind = 2 AND t = 'signup' THEN 'UNRESOLVED name' WHEN k % 5 <> 0 THEN 'no. ' || k
    WHEN kind = 0 THEN 'clj-kondo reported ' || {_case('t', _CODES[0][1])} WHEN kind = 1 THEN rule WHEN kind = 2 THEN 'StaticLint reported ' || rule
    ELSE 'JET reported a possible Julia issue' END AS message,
  CASE {_SUGGESTED} END AS suggestion FROM r WHERE rule IS NOT NULL""")
def _(spark, d):
    return linters.findings(_reports(spark, d))


@query("malformed_reports", f"""WITH {_RUNS} SELECT CASE kind WHEN 0 THEN 'clj-kondo' WHEN 1 THEN 'clippy' WHEN 2 THEN 'staticlint' ELSE 'jet' END AS tool, path,
  CAST(CASE WHEN kind = 1 THEN 2 ELSE 1 END AS INTEGER) AS line FROM e WHERE k % 11 = 0""")
def _(spark, d):
    return linters.malformed(_reports(spark, d))
