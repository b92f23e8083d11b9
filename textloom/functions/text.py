"""Scalar functions over lines, identifiers, keys and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: comment tokens by language, allowed numbers, operators of two characters
COMMENTS = {"python": "#", "julia": "#", "generic": "#", "clojure": ";", "javascript": "//", "typescript": "//", "rust": "//"}
ALLOWED_NUMBERS = ("-1", "0", "1", "2", "0.0", "1.0", "2.0")
TOKEN = r"[A-Za-z0-9_]+|==|!=|<=|>=|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|[^\sA-Za-z0-9_]"
NARRATION = r"(?i)^(import|initialize|define|create|loop|iterate|return|set|get|check|increment|call|assign|print|update|add|remove|now|first|then|next|finally|step\s*\d+|handle|store|compute|calculate|convert|build|setup|start|end|begin|this\s+(function|method|block|loop|line|variable|code)|we\s+(now|then|will|need)|let'?s)\b"
STUB = r"(?i)(todo!\s*\(|unimplemented!\s*\(|TODO\s*:?\s*implement|throw\b.*TODO|error\s*\(\s*[\"']TODO|@assert\s+false|not\s+implemented|\bplaceholder\b)"


def comment_token(lang: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COMMENTS.items() for x in kv])[lang], F.lit("#"))


def comment_at(line: Column, token: Column) -> Column:
    """0-based place of the first comment token, null if none; strings are not looked at."""
    at = F.position(token, line)
    return F.when(at > 0, at - 1)


def code_before_comment(line: Column, token: Column) -> Column:
    at = comment_at(line, token)
    return F.when(at.isNull(), line).otherwise(F.substring(line, F.lit(1), at.cast("int")))


def comment_text(line: Column, token: Column) -> Column:
    at = comment_at(line, token)
    return F.when(at.isNotNull(), F.substring(line, (at + F.length(token) + 1).cast("int"), F.length(line)))


def is_banner(text: Column) -> Column:
    return text.rlike(r"^[\s\-=*#/~_]{6,}$")


def magic_numbers(code: Column) -> Column:
    """Numeric literals of a line of code that are not glued to a name and not among the allowed ones."""
    marked = F.regexp_extract_all(code, F.lit(r"([A-Za-z0-9_]*-?[0-9][0-9.]*[A-Za-z_]?)"), F.lit(1))
    whole = F.filter(marked, lambda x: x.rlike(r"^-?[0-9][0-9.]*$"))
    return F.filter(whole, lambda x: ~x.isin(*ALLOWED_NUMBERS))


def skips_magic_numbers(code: Column) -> Column:
    trimmed = F.trim(code)
    return (trimmed == "") | trimmed.rlike(r"^(const |static |\(def |:|struct |enum )") | trimmed.contains("#[") | trimmed.contains("::")


def normalized_identifier(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]"), "NUM").when(token.rlike("[A-Za-z_]"), "ID").otherwise(token)


def normalized_key(key: Column) -> Column:
    return F.lower(F.translate(key, "-_.:", ""))


def env_shaped(key: Column) -> Column:
    return key.rlike("^[A-Z0-9_]{4,}$") & key.rlike("[A-Z]")


def key_shaped(text: Column) -> Column:
    return (F.length(text) <= 64) & text.rlike("[A-Za-z]") & text.rlike(r"^[A-Za-z0-9_.:-]+$") & ~text.contains("::") & ~text.rlike(r"^\.|\.$")


def token_leaf(token: Column) -> Column:
    return F.element_at(F.split(token, r"\."), -1)


def token_root(token: Column) -> Column:
    return F.element_at(F.split(token, r"\."), 1)


def type_like(token: Column) -> Column:
    return token_leaf(token).rlike("^[A-Z]")


def normalized_reference(text: Column) -> Column:
    return F.regexp_replace(text, r"^(self\.|this\.)", "")


def normalized_call(text: Column, most: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.octet_length(flat) > most, F.sha2(flat.cast("binary"), 256)).otherwise(flat)


def normalized_literal(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")


def qualified_segments(label: Column) -> Column:
    return F.filter(F.split(label, r"::|\.|/"), lambda x: F.trim(x) != "")


def schema_subject(name: Column, prefixes: str = "build|make|produce|verify|validate|check|read|parse") -> Column:
    found = F.regexp_extract(name, rf"^(?:{prefixes})_(.+)$", 1)
    return F.when(found != "", found)


def in_test(path: Column, name: Column) -> Column:
    return name.rlike("^test_") | path.rlike(r"(^|/)tests?/") | path.rlike(r"_test\.[A-Za-z]+$") | path.rlike(r"(^|/)test_[^/]*$")


def generated_source(text: Column) -> Column:
    return F.substring(text, 1, 4096).contains("@generated")


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*```[A-Za-z0-9]*\n|\n?```\s*$", "")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def bounded_ratio(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), ratio(a, b))


def ratio_less(a_num: Column, a_den: Column, b_num: Column, b_den: Column) -> Column:
    """Exact comparison of ratios by cross-multiplication."""
    wide = "decimal(18,0)"
    return a_num.cast(wide) * b_den.cast(wide) < b_num.cast(wide) * a_den.cast(wide)


def saturating(x: Column, half: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x / (x + half))


def maintainability(volume: Column, cyclomatic: Column, nloc: Column) -> Column:
    raw = 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.ln(nloc)
    return F.when(nloc == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)))


def size_bin(nloc: Column) -> Column:
    return F.when(nloc <= 15, "0-15").when(nloc <= 31, "16-31").when(nloc <= 63, "32-63").when(nloc <= 127, "64-127").otherwise("128+")


def logistic(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n, p = total.cast("double"), successes / total
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(total == 0, 0.0).otherwise(low), F.when(total == 0, 1.0).otherwise(high)
