"""Contract facts of functions over revisions, and what refactorings left behind.

A contract row: revision, ix, path, name, refs, literals, config_keys (sorted sets), calls (map of call text to
count), loops, fp (fingerprint of the body). Detectors compare adjacent revisions by (path, name) or look at one.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X

SCHEMA = "ix int, path string, name string, refs array<string>, literals array<string>, config_keys array<string>, calls map<string,bigint>, loops int, fp string"
# fixed values: leaves of names by what they tell
FLATTEN = "flatten ravel flat concat concatenate chain vcat hcat vstack hstack stack".split()
LOSSY = "argmax argmin round floor ceil clip clamp quantize sign threshold onehot".split()
TELEMETRY = "metrics metric statsd prometheus telemetry logger log gauge counter histogram".split()
STATUS = "status health heartbeat watchdog registry".split()
DYNAMIC = "getattr setattr eval exec globals locals vars __import__ getfield invokelatest".split()
#: A token held by more functions is a shared utility, not something one function owns.
SHARED = 3
LEAST_CALL, MOST_CALL = 24, 200


def extract(files: DataFrame) -> DataFrame:
    """Contracts of the Python functions in (ix, path, text)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ix, path, text in zip(group["ix"], group["path"], group["text"], strict=True):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError):
                continue
            for f in ast.walk(tree):
                if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    continue
                refs, literals, keys, calls = set(), set(), set(), {}
                for x in (y for s in f.body for y in ast.walk(s)):
                    if isinstance(x, ast.Constant) and isinstance(x.value, str):
                        literals.add(x.value)
                    elif isinstance(x, ast.Attribute):
                        refs.add(re.sub(r"^(self|this)\.", "", ast.unparse(x)))
                    elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
                        refs.add(x.id)
                    if isinstance(x, ast.Call):
                        call = " ".join(ast.unparse(x).split())
                        call = call if len(call.encode()) <= MOST_CALL else hashlib.sha256(call.encode()).hexdigest()
                        calls[call] = calls.get(call, 0) + 1
                        if re.search(r"(get|env|config|option|setting)", ast.unparse(x.func), re.I):
                            keys |= {a.value for a in x.args if isinstance(a, ast.Constant) and isinstance(a.value, str)}
                body = "\n".join(ast.dump(s) for s in f.body)
                loops = sum(isinstance(x, (ast.For, ast.While, ast.AsyncFor)) for x in ast.walk(f))
                rows.append((ix, path, f.name, sorted(refs), sorted(literals), sorted(keys), calls, loops, hashlib.sha256(body.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(r", (?=\w+ )", SCHEMA)])

    return files.groupBy("ix", "path").applyInPandas(run, SCHEMA)


def adjacent(c: DataFrame) -> DataFrame:
    """Functions of the same path and name in revisions ix and ix + 1, columns b_* and a_*."""
    side = lambda p, shift: c.select("path", "name", (F.col("ix") + shift).alias("ix"), *[F.col(x).alias(f"{p}_{x}") for x in c.columns if x not in ("path", "name", "ix")])
    return side("b", 0).join(side("a", -1), ["path", "name", "ix"])


def popularity(c: DataFrame, domain: str) -> DataFrame:
    return c.select("ix", "path", "name", F.explode(domain).alias("token")).groupBy("ix", "token").agg(F.count("*").alias("holders"))


def migrations(c: DataFrame, domain: str = "refs") -> DataFrame:
    """Functions that lost and gained tokens, and the lost ones that other functions of the file still hold. Tokens held
    by many functions and, among references, type-like ones are left out."""
    pairs = adjacent(c).select("ix", "path", F.col("name").alias("owner"), F.array_except(f"b_{domain}", f"a_{domain}").alias("removed"), F.array_except(f"a_{domain}", f"b_{domain}").alias("added"))
    lost = pairs.where((F.size("removed") > 0) & (F.size("added") > 0)).select("ix", "path", "owner", "added", F.explode("removed").alias("token"))
    if domain == "refs":
        lost = lost.where(~X.type_like(F.col("token")))
    lost = lost.join(popularity(c, domain), ["ix", "token"]).where(F.col("holders") <= SHARED)
    held = c.select((F.col("ix") - 1).alias("ix"), "path", F.explode(domain).alias("token")).distinct()
    kept = lost.join(held, ["ix", "path", "token"])
    return kept.groupBy("ix", "path", "owner").agg(F.array_sort(F.collect_set("token")).alias("surviving"), F.first("added").alias("added"))


def stale_dependents(c: DataFrame, domain: str = "refs", tests: bool | None = None) -> DataFrame:
    """Functions that a migration left with a surviving token, unchanged themselves: ix, path, owner, dependent, stale."""
    m = migrations(c, domain).select("ix", F.col("path").alias("owner_path"), "owner", F.explode("surviving").alias("token"))
    same = adjacent(c).where(F.col(f"b_{domain}") == F.col(f"a_{domain}")).select("ix", "path", F.col("name").alias("dependent"), F.explode(f"a_{domain}").alias("token"))
    hit = same.join(m, ["ix", "token"]).where(X.token_leaf(F.col("token")) != F.col("dependent"))
    is_test = X.in_test(F.col("path"), F.col("dependent"))
    hit = hit.where(is_test) if tests else hit.where((F.col("path") == F.col("owner_path")) & (F.col("dependent") != F.col("owner")))
    return hit.groupBy("ix", "path", "owner", "dependent").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("stale"))


def inert_config(c: DataFrame) -> DataFrame:
    """Keys read before, read nowhere after, and still literals: ix, key, holders."""
    reads = c.select("ix", F.explode("config_keys").alias("key")).distinct()
    gone = reads.join(reads.select((F.col("ix") - 1).alias("ix"), "key"), ["ix", "key"], "left_anti")
    holders = c.select((F.col("ix") - 1).alias("ix"), F.explode("literals").alias("key"), F.concat_ws(":", "path", "name").alias("holder"))
    return gone.join(holders, ["ix", "key"]).groupBy("ix", "key").agg(F.array_join(F.array_sort(F.collect_set("holder")), ",").alias("holders"))


def scope_collapses(c: DataFrame) -> DataFrame:
    """Functions that lost a loop and gained a flattening reference."""
    gained = F.filter(F.array_except("a_refs", "b_refs"), lambda x: X.token_leaf(x).isin(FLATTEN))
    return adjacent(c).where((F.col("a_loops") < F.col("b_loops")) & (F.size(gained) > 0)).select("ix", "path", "name", F.array_join(F.array_sort(gained), ",").alias("gained"))


def lossy_dependents(c: DataFrame) -> DataFrame:
    """Changed functions with a lossy reference that gained nothing."""
    lossy = F.filter("a_refs", lambda x: X.token_leaf(x).isin(LOSSY))
    return adjacent(c).where((F.col("a_fp") != F.col("b_fp")) & (F.size(lossy) > 0) & (F.size(F.array_except("a_refs", "b_refs")) == 0)).select("ix", "path", "name", F.array_join(F.array_sort(lossy), ",").alias("lossy"))


def nominable(call: Column) -> Column:
    """Calls worth telling: long enough, with a call inside, and no mere construction; digests of longer ones too."""
    return call.rlike("^[0-9a-f]{64}$") | ((F.length(call) >= LEAST_CALL) & call.rlike(r"\(.*\(") & ~call.rlike(r"^([A-Za-z_0-9]+\.)*[A-Z][A-Za-z0-9_]*\("))


def repeated_work(c: DataFrame) -> DataFrame:
    """Calls made twice or more after and at most once before, without those inside a longer one that is told."""
    pair = adjacent(c)
    again = pair.select("ix", "path", "name", "b_calls", F.explode("a_calls").alias("call", "n")).where((F.col("n") >= 2) & (F.coalesce(F.try_element_at("b_calls", F.col("call")), F.lit(0)) <= 1) & nominable(F.col("call")))
    texts = again.groupBy("ix", "path", "name").agg(F.collect_list(F.struct("call", "n")).alias("calls"))
    inside = lambda x: F.exists("calls", lambda y: (F.length(y["call"]) > F.length(x["call"])) & F.contains(y["call"], x["call"]))
    return texts.select("ix", "path", "name", F.explode(F.filter("calls", lambda x: ~inside(x))).alias("x")).select("ix", "path", "name", "x.call", "x.n")


def persistence(c: DataFrame, stale: DataFrame) -> DataFrame:
    """For how many later revisions in a row each stale finding's function stays as it is, and how often its owner changed."""
    fp = c.select("ix", "path", "name", "fp")
    base = stale.select("ix", "path", "owner", "dependent").join(fp.select((F.col("ix") - 1).alias("ix"), "path", F.col("name").alias("dependent"), F.col("fp").alias("was")), ["ix", "path", "dependent"])
    later = fp.select(F.col("ix").alias("at"), "path", F.col("name").alias("dependent"), "fp")
    j = base.join(later, ["path", "dependent"]).where("at > ix").groupBy("ix", "path", "owner", "dependent").agg(F.min(F.when(F.col("fp") != F.col("was"), F.col("at"))).alias("broken"), F.max("at").alias("last"))
    return j.select("ix", "path", "owner", "dependent", (F.coalesce(F.col("broken") - 1, F.col("last")) - F.col("ix")).cast("int").alias("persisted"))


def chains(*families: tuple[str, DataFrame]) -> DataFrame:
    """Owners told by two families or more."""
    every = None
    for name, df in families:
        part = df.select("ix", "path", "owner", F.lit(name).alias("family"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("ix", "path", "owner").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct("family").alias("n")).where("n >= 2")


def roles(c: DataFrame) -> DataFrame:
    """The first role that fits each function: test, verifier, identity, telemetry, producer, owner, consumer."""
    surface = lambda words: F.exists("refs", lambda r: F.coalesce(F.get(F.split(r, r"\."), F.size(F.split(r, r"\.")) - 2), F.lit("")).isin(words))
    role = F.when(X.in_test(F.col("path"), F.col("name")), "test").when(F.col("name").rlike("^(verify|validate|check|assert)"), "verifier").when(surface(STATUS), "identity").when(surface(TELEMETRY), "telemetry").when(F.col("name").rlike("^(build|make|produce|create|emit)"), "producer").when(F.size("refs") == 0, "owner").otherwise("consumer")
    return c.select("ix", "path", "name", role.alias("role"))


def schema_mismatches(c: DataFrame) -> DataFrame:
    """Producers and verifiers of one subject in a file whose literals differ."""
    own = c.select("ix", "path", "name", "literals", X.schema_subject(F.col("name")).alias("subject")).where("subject IS NOT NULL")
    made = own.where(F.col("name").rlike("^(build|make|produce)_")).select("ix", "path", "subject", F.col("name").alias("producer"), F.col("literals").alias("p"))
    read = own.where(~F.col("name").rlike("^(build|make|produce)_")).select("ix", "path", "subject", F.col("name").alias("verifier"), F.col("literals").alias("v"))
    j = made.join(read, ["ix", "path", "subject"]).where((F.size("p") > 0) & (F.size("v") > 0) & (F.col("p") != F.col("v")))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return j.select("ix", "path", "producer", "verifier", text(F.array_except("p", "v")).alias("missing"), text(F.array_except("v", "p")).alias("unknown"))


def unreached_config(c: DataFrame) -> DataFrame:
    """Literals shaped like environment keys that nothing reads; none where names are looked up dynamically."""
    dynamic = c.select("ix", F.exists("refs", lambda r: X.token_leaf(r).isin(DYNAMIC)).alias("d")).groupBy("ix").agg(F.max("d").alias("d"))
    keys = c.select("ix", "path", F.explode("literals").alias("key")).where(X.env_shaped(F.col("key")))
    reads = c.select("ix", F.explode("config_keys").alias("key")).distinct()
    return keys.join(reads, ["ix", "key"], "left_anti").join(dynamic, "ix").where("NOT d").select("ix", "path", "key").distinct()


def sibling_gates(c: DataFrame, least_shared: int = 2, most_apart: int = 8) -> DataFrame:
    """Pairs of gates in a file that share references and differ in some, by an inverted index of references."""
    gates = c.where(F.col("name").rlike("^(check|verify|validate|guard|admit|require)")).select("ix", "path", "name", "refs")
    at = gates.select("ix", "path", "name", F.explode("refs").alias("r"))
    pairs = at.withColumnRenamed("name", "x").join(at.withColumnRenamed("name", "y"), ["ix", "path", "r"]).where("x < y").groupBy("ix", "path", "x", "y").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    full = pairs.join(gates.withColumnsRenamed({"name": "x", "refs": "rx"}), ["ix", "path", "x"]).join(gates.withColumnsRenamed({"name": "y", "refs": "ry"}), ["ix", "path", "y"])
    apart = F.concat(F.array_except("rx", "ry"), F.array_except("ry", "rx"))
    return full.where((F.size(apart) > 0) & (F.size(apart) <= most_apart)).select("ix", "path", "x", "y", "shared", F.array_join(F.array_sort(apart), ",").alias("apart"))


def reach_of(c: DataFrame) -> DataFrame:
    """ix, name, token: every token in the closure of each function's references, by way of functions that they name."""
    from textloom.operators.graphs import fixpoint

    refs = c.select("ix", "name", F.explode("refs").alias("token")).distinct()
    named = c.select("ix", F.col("name").alias("via")).distinct()
    calls = refs.join(named, (refs["ix"] == named["ix"]) & (X.token_leaf(refs["token"]) == named["via"])).select(refs["ix"], "name", "via")
    return fixpoint(refs, lambda new: new.join(calls.select("ix", F.col("via").alias("name"), F.col("name").alias("from_")), ["ix", "name"]).select("ix", F.col("from_").alias("name"), "token"), ["ix", "name", "token"])


def surface_kind(c: DataFrame) -> DataFrame:
    """ix, path, name, kind: gates by name, telemetry and identity by the object whose method they call."""
    owner = lambda words: F.exists("refs", lambda r: F.coalesce(F.get(F.split(r, r"\."), F.size(F.split(r, r"\.")) - 2), F.lit("")).isin(words))
    kinds = F.array_compact(F.array(F.when(F.col("name").rlike("^(check|verify|validate)"), "gate"), F.when(owner(TELEMETRY), "telemetry"), F.when(owner(STATUS), "identity")))
    return c.select("ix", "path", "name", F.explode(kinds).alias("kind"))


def retired_surfaces(c: DataFrame) -> DataFrame:
    """Surfaces that a migration left behind: unchanged functions of a kind that still reach a surviving token and none of
    those gained: ix, owner, kind, name."""
    m = migrations(c)
    lost = m.select("ix", "owner", F.explode("surviving").alias("token"))
    gained = m.select("ix", "owner", F.explode("added").alias("token"))
    after = reach_of(c).select((F.col("ix") - 1).alias("ix"), "name", "token")
    same = adjacent(c).where("b_fp = a_fp").select("ix", "path", "name").join(surface_kind(c).select((F.col("ix") - 1).alias("ix"), "path", "name", "kind"), ["ix", "path", "name"])
    old = after.join(lost, ["ix", "token"]).select("ix", "owner", "name").distinct()
    new = after.join(gained, ["ix", "token"]).select("ix", "owner", "name").distinct()
    return old.join(new, ["ix", "owner", "name"], "left_anti").join(same, ["ix", "name"]).where("name <> owner").select("ix", "owner", "kind", "name").distinct()


def contract_splits(c: DataFrame) -> DataFrame:
    """Behaviours and surfaces of a file that reach no terminal in common: ix, path, behaviour, surface, kind. Nothing is
    told of a revision that looks names up dynamically."""
    dynamic = c.select("ix", F.exists("refs", lambda r: X.token_leaf(r).isin(DYNAMIC)).alias("d")).groupBy("ix").agg(F.max("d").alias("d"))
    names = c.select("ix", F.col("name").alias("leaf")).distinct()
    ends = reach_of(c).withColumn("leaf", X.token_leaf(F.col("token"))).join(names, ["ix", "leaf"], "left_anti").groupBy("ix", "name").agg(F.collect_set("token").alias("ends"))
    behave = c.where(F.col("name").rlike("^(decide|step|train|run|resume|execute|apply|process)")).select("ix", "path", F.col("name").alias("behaviour")).join(ends.toDF("ix", "behaviour", "x"), ["ix", "behaviour"])
    surface = surface_kind(c).withColumnRenamed("name", "surface").join(ends.toDF("ix", "surface", "y"), ["ix", "surface"])
    j = behave.join(surface, ["ix", "path"]).where(~F.arrays_overlap("x", "y")).join(dynamic, "ix").where("NOT d")
    return j.select("ix", "path", "behaviour", "surface", "kind")


def untested_dimensions(c: DataFrame) -> DataFrame:
    """Flattening functions that fewer than two distinct calls in tests exercise: ix, path, name, calls."""
    users = c.where(F.exists("refs", lambda r: X.token_leaf(r).isin(FLATTEN)) & ~X.in_test(F.col("path"), F.col("name"))).select("ix", "path", "name")
    tests = c.where(X.in_test(F.col("path"), F.col("name"))).select("ix", F.explode(F.map_keys("calls")).alias("call"))
    called = tests.select("ix", "call", F.explode(F.array_distinct(F.regexp_extract_all("call", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("name"))
    hits = users.join(called, ["ix", "name"]).groupBy("ix", "path", "name").agg(F.count_distinct("call").alias("calls"))
    return users.join(hits, ["ix", "path", "name"], "left").select("ix", "path", "name", F.coalesce("calls", F.lit(0)).alias("calls")).where("calls < 2")
