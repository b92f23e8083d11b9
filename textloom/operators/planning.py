"""Work orders: grouping findings by region, conflicts, atomic groups, waves, expiry, verdicts, mutants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graphs import weak_components
from textloom.operators.metrics import cumulated

ELIGIBLE = ("analyzer-confirmed", "safe-with-precondition", "risky-suggest", "llm-only")


def drafts(findings: DataFrame) -> DataFrame:
    """Eligible findings by region, without regions that a never-auto finding touches. findings: path, region, rule, safety, line."""
    barred = findings.where("safety = 'never-auto'").select("path", "region").distinct()
    own = findings.where(F.col("safety").isin(*ELIGIBLE)).join(barred, ["path", "region"], "left_anti")
    return own.groupBy("path", "region").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.min("line").alias("first_line"))


def order_edges(access: DataFrame) -> DataFrame:
    """(a, b, kind) between orders by what they do to a resource: writer before reader of it as prerequisite, two writers
    conflict, an invalidator and a reader too. access: id, resource, mode (read, write, require, invalidate)."""
    x, y = access.toDF("a", "resource", "m"), access.toDF("b", "resource", "n")
    pairs = x.join(y, "resource").where("a <> b")
    kind = F.when((F.col("m") == "write") & (F.col("n") == "require"), "prerequisite").when((F.col("m") == "write") & (F.col("n") == "write") & (F.col("a") < F.col("b")), "write-conflict").when((F.col("m") == "invalidate") & F.col("n").isin("read", "require"), "invalidates").when((F.col("m") == "write") & (F.col("n") == "read"), "read-conflict")
    return pairs.select("a", "b", kind.alias("kind")).where("kind IS NOT NULL").distinct()


def atomic_groups(orders: DataFrame, together: DataFrame) -> DataFrame:
    """Orders with the smallest order of their declared group. orders: id; together: a, b."""
    return weak_components(orders.select(F.col("id").alias("node")), together).select(F.col("node").alias("id"), F.col("component").alias("group_"))


def waves(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """id, wave, blocked: orders on a prerequisite cycle are blocked, and what depends on them; of the rest each wave
    takes, in order of id, those with no open prerequisite that conflict with none in it. A plan is one group."""

    def run(_, ids: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(ids["id"])
        need: dict[str, set] = {i: set() for i in ids}
        clash: dict[str, set] = {i: set() for i in ids}
        for a, b, kind in zip(links["a"], links["b"], links["kind"], strict=True):
            if kind == "prerequisite":
                need[b].add(a)
            else:
                clash[a].add(b)
                clash[b].add(a)
        open_, wave, out = set(ids), 0, []
        while True:
            taken: list[str] = []
            for i in sorted(open_):
                if not (need[i] & open_) and not (clash[i] & set(taken)) and not (need[i] & set(taken)):
                    taken.append(i)
            if not taken:
                break
            out += [(i, wave, False) for i in taken]
            open_ -= set(taken)
            wave += 1
        out += [(i, -1, True) for i in sorted(open_)]
        return pd.DataFrame(out, columns=["id", "wave", "blocked"])

    one = F.lit(0).alias("plan")
    return orders.select(one, "id").groupBy("plan").cogroup(edges.select(one, "a", "b", "kind").groupBy("plan")).applyInPandas(run, "id string, wave int, blocked boolean")


def replanned(orders: DataFrame, access: DataFrame, invalid: DataFrame) -> DataFrame:
    """id, state: expired where an order reads or requires an invalidated resource, else retained."""
    hit = access.where(F.col("mode").isin("read", "require")).join(invalid, "resource").select("id").distinct().withColumn("state", F.lit("expired"))
    return orders.select("id").join(hit, "id", "left").select("id", F.coalesce("state", F.lit("retained")).alias("state"))


def verdicts(patches: DataFrame) -> DataFrame:
    """patch: id, characterized, mutation (survived, killed, none), coverage (covered, uncovered, unknown), blank."""
    dead = F.when(F.col("blank"), "dead-candidate").otherwise("untested-risky")
    v = F.when(F.col("characterized"), "removable").when(F.col("mutation") == "survived", dead).when(F.col("coverage") == "covered", "removable").when(F.col("coverage") == "uncovered", dead).otherwise("coverage-unknown")
    return patches.select("id", v.alias("verdict"))


def guards(patches: DataFrame, most_growth: float = 1.5) -> DataFrame:
    """Why a patch is turned down: growth, removed defensive code, new public definitions. patches: id, before, after."""
    count = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    defensive, public = r"\b(raise|assert|try|except|throw|catch)\b", r"(?m)^\s*(?:pub\s+fn|export\s+function|def\s+[a-z]\w*)()"
    reasons = F.array_compact(F.array(F.when(F.length("after") > most_growth * F.length("before"), "growth"), F.when(count("after", defensive) < count("before", defensive), "defensive-code-removed"), F.when(count("after", public) > count("before", public), "new-public-definition")))
    return patches.select("id", F.array_join(reasons, ",").alias("rejected"))


# fixed values: what a mutant puts in a token's place
SWAPS = {"<": "<=", "<=": "<", ">": ">=", ">=": ">", "==": "!=", "!=": "==", "+": "-", "-": "+", "*": "/", "/": "*", "&&": "||", "||": "&&", "and": "or", "or": "and", "true": "false", "false": "true", "True": "False", "False": "True"}


def mutants(tokens: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """A row for each token that has a swap, on covered lines if those are given: path, line_no, idx, token, replacement."""
    swap = F.create_map(*[F.lit(x) for kv in SWAPS.items() for x in kv])
    out = tokens.where(~F.col("is_comment")).select("path", "line_no", "idx", "token", F.try_element_at(swap, F.col("token")).alias("replacement")).where("replacement IS NOT NULL")
    return out if covered is None else out.join(covered.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi")


def mutant_tally(outcomes: DataFrame) -> DataFrame:
    g = outcomes.groupBy("path").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("killed", "survived", "unviable")])
    return g.withColumn("score", F.round(F.when(F.col("killed") + F.col("survived") > 0, F.col("killed") / (F.col("killed") + F.col("survived"))), 6))


def budgeted(items: DataFrame, key: str, cost: str, budget: float, after=None) -> DataFrame:
    """The first items by key whose running cost fits, with the running cost; ``after`` resumes behind a key."""
    rows = items if after is None else items.where(F.col(key) > after)
    # costs are summed within ranges of the key, and the ranges before are added
    placed = cumulated(rows, key, cost).withColumn("running", F.col("before") + F.col(cost))
    return placed.where(F.col("running") <= budget).drop("before", "count")


def statuses(files: DataFrame, by: str) -> DataFrame:
    """The status of a set of files: complete, failed, unknown, unsupported or partial, in that order of what settles it."""
    is_ = lambda s: F.col("status") == s
    s = F.when(F.bool_and(is_("complete")), "complete").when(F.bool_or(is_("failed")), "failed").when(F.bool_or(is_("unknown")), "unknown").when(F.bool_and(is_("unsupported")), "unsupported").otherwise("partial")
    return files.groupBy(by).agg(s.alias("status"))


def evidence(required: DataFrame, given: DataFrame) -> DataFrame:
    """id, satisfied, counter: whether every required kind has passing evidence, and how much speaks against."""
    g = given.groupBy("id", "kind").agg(F.bool_or("passed").alias("ok"), F.count_if(~F.col("passed")).alias("against"))
    j = required.join(g, ["id", "kind"], "left")
    return j.groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("satisfied"), F.sum(F.coalesce("against", F.lit(0))).alias("counter"))

