"""Lines, tokens and the rules that look at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.shared import spread

# fixed values: (rule, language, pattern) of the rules that one line settles
IDIOMS: list[tuple[str, str, str]] = [
    ("reimpl-not=", "clojure", r"\(not\s+\(=\s+([^()\n]+?)\)\)"),
    ("reimpl-some?", "clojure", r"\(not\s+\(nil\?\s+([^()\n]+?)\)\)"),
    ("reimpl-boolean", "clojure", r"\(if\s+(\([^()\n]+?\)|[^()\n]+?)\s+true\s+false\)"),
    ("redundant-do", "clojure", r"\((when(?:-not)?)\s+([^()\n]+?)\s+\(do\s+(.+?)\)\)"),
    ("reimpl-empty?", "clojure", r"\(=\s+\(count\s+([^()]+?)\)\s+0\)"),
    ("reimpl-seq", "clojure", r"\(>\s+\(count\s+([^()]+?)\)\s+0\)"),
    ("reimpl-vec", "clojure", r"\(reduce\s+conj\s+\[\]\s"),
    ("reimpl-isempty", "julia", r"length\(([^()\n]+)\)\s*==\s*0"),
    ("reimpl-isnothing", "julia", r"([^=!<>\n]+)\s*==\s*nothing"),
    ("reimpl-eachindex", "julia", r"^\s*for\s+([A-Za-z_]\w*)\s+in\s+1:length\(([^()\n]+)\)\s*(?:#.*)?$"),
    ("useless-format", "rust", r"format!\s*\(\s*\"\{\}\"\s*,\s*([^)]+)\)"),
    ("py-none-comparison", "python", r"(?:==|!=)\s*None\b|\bNone\s*(?:==|!=)"),
    ("py-range-len", "python", r"\brange\s*\(\s*len\s*\("),
    ("py-dict-keys-membership", "python", r"\bin\s+[A-Za-z_][A-Za-z0-9_.]*\.keys\s*\(\s*\)"),
    ("py-list-comprehension-wrapper", "python", r"\blist\s*\(\s*\["),
    ("js-loose-equality", "javascript", r"(^|[^=!])(?:==|!=)([^=]|$)"),
    ("js-loose-equality", "typescript", r"(^|[^=!])(?:==|!=)([^=]|$)"),
    ("js-var-declaration", "javascript", r"^\s*var\s+"),
    ("js-var-declaration", "typescript", r"^\s*var\s+"),
    ("js-unnecessary-await", "javascript", r"\breturn\s+await\b"),
    ("js-unnecessary-await", "typescript", r"\breturn\s+await\b"),
]
# fixed values: points of a finding towards a file's slop score
SLOP_WEIGHTS: list[tuple[str, float]] = [
    ("incompleteness", 25.0), ("long-method", 15.0), ("duplicate-block", 10.0), ("near-duplicate", 10.0), ("comment-block", 5.0), ("narrating-comment", 5.0),
    ("magic-number", 4.0), ("needless-clone", 4.0), ("needless-return", 4.0), ("let-and-return", 4.0),
]


def lines_of(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A row for each line: the keys, line_no from 1, line and start_byte. A final line feed ends the last line."""
    rows = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("pos", "line"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum((F.octet_length("line") + 1).cast("long")).over(before), F.lit(0)).cast("long")
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line", start.alias("start_byte"))


def plain_lines(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Like ``lines_of`` without byte offsets, and so without a shuffle."""
    rows = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("pos", "line"))
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def tokens_of(lines: DataFrame, *keys: str, lang: Column | None = None) -> DataFrame:
    """A row for each token of a line: keys, line_no, idx within the line, token, is_comment."""
    token = X.comment_token(lang) if lang is not None else F.lit("#")
    at = X.comment_at(F.col("line"), token)
    code, comment = X.code_before_comment(F.col("line"), token), F.when(at.isNotNull(), F.substring(F.col("line"), (at + 1).cast("int"), F.length("line")))
    mark = lambda text, flag: F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(f"({X.TOKEN})"), F.lit(1)), F.array()), lambda t: F.struct(t.alias("token"), F.lit(flag).alias("is_comment")))
    rows = lines.select(*keys, "line_no", F.posexplode(F.concat(mark(code, False), mark(comment, True))).alias("idx", "t"))
    return rows.select(*keys, "line_no", (F.col("idx") + 1).cast("long").alias("idx"), F.col("t.token").alias("token"), F.col("t.is_comment").alias("is_comment"))


def idiom_findings(lines: DataFrame) -> DataFrame:
    """path, line_no, rule for each line that a rule of its language matches, once a rule."""
    found = F.array(*[F.when((F.col("lang") == lang) & F.col("line").rlike(pattern), F.lit(rule)) for rule, lang, pattern in IDIOMS])
    return lines.select("path", "line_no", F.explode(F.array_distinct(F.array_compact(found))).alias("rule"))


def islands(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of consecutive values of ``order`` within the keys: first, last."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("run", F.col(order) - F.row_number().over(w)).groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("run")


def blank_runs(lines: DataFrame) -> DataFrame:
    """path, start_line, end_line of the blank lines beyond those allowed (2 in Python, else 1)."""
    blank = islands(lines.where(F.trim("line") == "").select("path", "lang", "line_no"), ["path", "lang"], "line_no")
    allowed = F.when(F.col("lang") == "python", 2).otherwise(1)
    return blank.where(F.col("last") - F.col("first") + 1 > allowed).select("path", (F.col("first") + allowed).alias("start_line"), F.col("last").alias("end_line"))


def comment_lines(lines: DataFrame) -> DataFrame:
    """Lines with their comment: full (nothing before it) and its text."""
    token = X.comment_token(F.col("lang"))
    code = X.code_before_comment(F.col("line"), token)
    body = F.trim(X.comment_text(F.col("line"), token))
    return lines.select("path", "lang", "line_no", "line", body.alias("comment"), (body.isNotNull() & (F.trim(code) == "")).alias("full"))


def comment_blocks(lines: DataFrame) -> DataFrame:
    """Runs of four or more full comment lines after the first code."""
    marked = comment_lines(lines)
    code = marked.where(~F.col("full") & (F.trim("line") != "")).groupBy("path").agg(F.min("line_no").alias("code"))
    runs = islands(marked.where("full"), ["path"], "line_no")
    return runs.join(code, "path").where("last - first >= 3 AND first > code").select("path", F.col("first").alias("start_line"), F.col("last").alias("end_line"))


def narrating_comments(lines: DataFrame) -> DataFrame:
    """Comments of at most nine words that tell what the code does, outside comment blocks."""
    marked = comment_lines(lines)
    block = islands(marked.where("full"), ["path"], "line_no").where("last > first").select("path", F.explode(F.sequence("first", "last")).alias("line_no"))
    few = F.size(F.regexp_extract_all("comment", F.lit(r"(\S+)"), F.lit(1))) <= 9
    told = marked.where(F.col("comment").isNotNull() & (F.col("comment") != "") & few & ~X.is_banner(F.col("comment")) & F.col("comment").rlike(X.NARRATION))
    return told.join(block, ["path", "line_no"], "left_anti").select("path", "line_no", "comment")


def first_magic_numbers(lines: DataFrame) -> DataFrame:
    """The first line of each file with a number to name, and the number."""
    code = X.code_before_comment(F.col("line"), X.comment_token(F.col("lang")))
    code = F.regexp_replace(F.regexp_replace(code, r'"[^"]*"', '""'), r"'[^']*'", "''")
    found = lines.select("path", "line_no", code.alias("code")).where(~X.skips_magic_numbers(F.col("code"))).select("path", "line_no", F.get(X.magic_numbers(F.col("code")), 0).alias("number")).where("number IS NOT NULL")
    first = found.groupBy("path").agg(F.min_by(F.struct("line_no", "number"), "line_no").alias("x"))
    return first.select("path", "x.line_no", "x.number")


def incompleteness(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(X.STUB)).select("path", "line_no")


def let_and_return(lines: DataFrame) -> DataFrame:
    """A binding that the next line gives back at once."""
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line_no"))
    name = F.regexp_extract("line", r"^\s*let\s+([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return lines.where("lang = 'rust'").select("path", "line_no", name.alias("name"), F.regexp_replace(F.trim(after), ";$", "").alias("after")).where("name <> '' AND name = after").select("path", "line_no", "name")


def nloc(lines: DataFrame, *keys: str, lang: Column | None = None) -> DataFrame:
    token = X.comment_token(lang) if lang is not None else F.lit("#")
    return lines.groupBy(*keys).agg(F.count_if(F.trim(X.code_before_comment(F.col("line"), token)) != "").alias("nloc"), F.count_if(F.trim("line") != "").alias("nonblank"))


def suppressions(lines: DataFrame) -> DataFrame:
    """path, line_no, rule of inline directives: ``lint-ignore rule,rule`` for the same and the next line; text after ``--`` is left out."""
    body = F.regexp_extract("line", r"lint-ignore\s+([^\n]*)", 1)
    rules = F.split(F.trim(F.regexp_replace(body, r"--.*$", "")), r"[,\s]+")
    rows = lines.where(body != "").select("path", "line_no", F.explode(rules).alias("rule")).where("rule <> ''")
    return rows.select("path", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"), "rule").distinct()


def unsuppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings that no directive covers, by an anti-join on their lines."""
    every = findings.join(directives.where("rule = '*'").select("path", "line_no").distinct(), ["path", "line_no"], "left_anti")
    return every.join(directives, ["path", "line_no", "rule"], "left_anti")


def slop_scores(findings: DataFrame, nonblank: DataFrame, weights: DataFrame, key: str = "path") -> DataFrame:
    """min(100, 100 * points / non-blank lines) of each file."""
    points = findings.join(F.broadcast(weights), "rule").groupBy(key).agg(F.sum("weight").alias("points"), F.count("*").alias("n"))
    score = F.when(F.col("nonblank") == 0, 0.0).otherwise(F.least(F.lit(100.0), 100 * F.coalesce("points", F.lit(0.0)) / F.col("nonblank")))
    return nonblank.join(points, key, "left").select(key, "nonblank", F.coalesce("n", F.lit(0)).cast("long").alias("findings"), F.round(score, 6).alias("score"))


def document_slop(docs: DataFrame, key: str, blocks: DataFrame, text: str = "text") -> DataFrame:
    """``slop_scores`` of prose, whose lines are looked at inside the row: unfinished lines, a number to name, and the
    duplicate blocks that ``blocks`` (key, blocks) counts. Only the last is joined; no line leaves its row."""
    docs = spread(docs.select(key, text))
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    stubs = F.when(F.col(text).rlike(X.STUB), F.size(F.filter(lines, lambda x: x.rlike(X.STUB)))).otherwise(0)
    number = F.col(text).rlike("[0-9]") & F.exists(lines, lambda x: x.rlike("[0-9]") & (F.size(X.magic_numbers(X.code_before_comment(x, F.lit("#")))) > 0))
    rows = docs.select(key, F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("nonblank"), stubs.alias("stubs"), F.coalesce(number, F.lit(False)).cast("int").alias("numbers"))
    weight = dict(SLOP_WEIGHTS)
    block = F.coalesce("blocks", F.lit(0))
    points = F.col("stubs") * weight["incompleteness"] + F.col("numbers") * weight["magic-number"] + block * weight["duplicate-block"]
    score = F.when(F.col("nonblank") == 0, 0.0).otherwise(F.least(F.lit(100.0), 100 * points / F.col("nonblank")))
    return rows.join(blocks, key, "left").select(key, "nonblank", (F.col("stubs") + F.col("numbers") + block).cast("long").alias("findings"), F.round(score, 6).alias("score"))


def single_use_bindings(lines: DataFrame) -> DataFrame:
    """Clojure bindings of one name whose body uses it once: path, line_no, name."""
    pattern = r"\(let\s+\[\s*([A-Za-z_][A-Za-z0-9_]*)\s+([^\]\n]+)\]\s+([^)]+)\)"
    name, body = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 3)
    uses = F.size(F.filter(F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_!?*<>=/+-]+)"), F.lit(1)), lambda t: t == name))
    return lines.where((F.col("lang") == "clojure") & (name != "") & (uses == 1)).select("path", "line_no", name.alias("name"))


def redundant_closures(lines: DataFrame) -> DataFrame:
    """Rust closures that only pass their argument on: path, line_no, callee."""
    pattern = r"\|\s*([a-z_][a-z0-9_]*)\s*\|\s*([A-Za-z_][A-Za-z0-9_:]*)\(\s*([a-z_][a-z0-9_]*)\s*\)"
    one, callee, two = (F.regexp_extract("line", pattern, k) for k in (1, 2, 3))
    return lines.where((F.col("lang") == "rust") & (one != "") & (one == two)).select("path", "line_no", callee.alias("callee"))


def needless_returns(files: DataFrame) -> DataFrame:
    """Rust functions that end in a return statement, one line each: path, returned."""
    found = F.regexp_extract_all("text", F.lit(r"return\s+([^;{}]+);\s*\}\s*(?:\n|$)"), F.lit(1))
    return files.where("lang = 'rust'").select("path", F.explode(found).alias("returned"))


def long_regions(nlocs: DataFrame, most: int = 40) -> DataFrame:
    """Regions of ``most`` lines of code or more."""
    return nlocs.where(F.col("nloc") >= most)
