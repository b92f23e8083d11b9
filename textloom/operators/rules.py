"""The registry of rules: name, safety class and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: rule, safety class, severity
RULES: list[tuple[str, str, str]] = [
    ("consecutive-blank-lines", "safe-auto", "minor"),
    ("reimpl-not=", "safe-auto", "minor"),
    ("reimpl-some?", "safe-auto", "minor"),
    ("reimpl-boolean", "safe-auto", "minor"),
    ("redundant-do", "safe-auto", "minor"),
    ("reimpl-empty?", "safe-with-precondition", "minor"),
    ("reimpl-seq", "safe-with-precondition", "minor"),
    ("reimpl-vec", "safe-with-precondition", "minor"),
    ("reimpl-isempty", "safe-with-precondition", "minor"),
    ("reimpl-eachindex", "safe-with-precondition", "minor"),
    ("useless-format", "safe-with-precondition", "minor"),
    ("py-none-comparison", "safe-with-precondition", "minor"),
    ("py-dict-keys-membership", "safe-with-precondition", "minor"),
    ("js-loose-equality", "safe-with-precondition", "minor"),
    ("js-var-declaration", "safe-with-precondition", "minor"),
    ("reimpl-isnothing", "risky-suggest", "minor"),
    ("py-range-len", "risky-suggest", "minor"),
    ("py-list-comprehension-wrapper", "risky-suggest", "minor"),
    ("js-unnecessary-await", "risky-suggest", "minor"),
    ("redundant-closure", "risky-suggest", "minor"),
    ("let-and-return", "risky-suggest", "minor"),
    ("single-use-binding", "risky-suggest", "minor"),
    ("magic-number", "risky-suggest", "minor"),
    ("needless-clone", "llm-only", "minor"),
    ("incompleteness", "llm-only", "major"),
    ("long-method", "llm-only", "major"),
    ("narrating-comment", "llm-only", "minor"),
    ("comment-block", "llm-only", "info"),
    ("duplicate-block", "llm-only", "major"),
    ("near-duplicate", "llm-only", "minor"),
    ("needless-return", "analyzer-confirmed", "minor"),
    ("unused-arg", "analyzer-confirmed", "minor"),
    ("unused-binding", "analyzer-confirmed", "minor"),
    ("unused-private-def", "analyzer-confirmed", "minor"),
    ("unused-namespace", "analyzer-confirmed", "minor"),
    ("slop-score", "report", "info"),
    ("missing-reference", "never-auto", "major"),
    ("julia-jet", "never-auto", "major"),
    ("config-key-unread", "never-auto", "minor"),
    ("config-key-unconsumed", "never-auto", "minor"),
    ("config-key-shadowed", "never-auto", "minor"),
    ("owner-moved-consumer-stale", "never-auto", "minor"),
    ("scope-collapse-after-refactor", "never-auto", "minor"),
    ("mechanism-live-gate-retired", "never-auto", "minor"),
    ("producer-verifier-schema-drift", "never-auto", "minor"),
    ("accepted-config-inert", "never-auto", "minor"),
    ("confidence-provenance-lost", "never-auto", "minor"),
    ("telemetry-not-bound-to-claim", "never-auto", "minor"),
    ("test-oracle-lag", "never-auto", "minor"),
    ("hot-path-work-duplicated", "never-auto", "minor"),
    ("operational-identity-stale", "never-auto", "minor"),
    ("adoption-chain-incomplete", "never-auto", "minor"),
    ("sibling-admission-gates-diverged", "never-auto", "minor"),
    ("owner-consumer-contract-split", "never-auto", "minor"),
    ("partition-boundary-not-preserved", "never-auto", "minor"),
    ("mechanism-gate-contract-split", "never-auto", "minor"),
    ("producer-verifier-schema-mismatch", "never-auto", "minor"),
    ("accepted-config-no-behavioral-reach", "never-auto", "minor"),
    ("confidence-derived-after-lossy-commit", "never-auto", "minor"),
    ("telemetry-claim-unbound", "never-auto", "minor"),
    ("test-contract-dimension-uncovered", "never-auto", "minor"),
    ("same-path-expensive-work-repeated", "never-auto", "minor"),
    ("published-identity-not-live", "never-auto", "minor"),
    ("contract-chain-incomplete", "never-auto", "minor"),
    ("sibling-admission-guards-asymmetric", "never-auto", "minor"),
]


def suppressed(findings: DataFrame, rules: list[str], paths: list[str], by_rule: dict[str, list[str]]) -> DataFrame:
    """Findings without disabled rules, ignored paths, and rules ignored under paths of their own (globs)."""
    out = findings.where(~F.col("rule").isin(rules)) if rules else findings
    for glob in paths:
        out = out.where(~F.col("path").rlike(glob_pattern(glob)))
    for rule, globs in by_rule.items():
        for glob in globs:
            out = out.where(~((F.col("rule") == rule) & F.col("path").rlike(glob_pattern(glob))))
    return out


def glob_pattern(glob: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and ``{a,b}`` as a pattern of whole paths."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if out.count("(?:") > out.count(")") else ","}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c)
        k += 1
    return f"^{out}$"
