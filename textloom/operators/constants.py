"""Constants along control flow, the arms that they decide, and chains of equality tests.

Control flow is rows, of all owners (functions, sessions) at once. ``edges`` are (owner, src, dst, variable, value,
holds): an edge without a variable is always open, another one where (variable = value) = holds. ``effects`` are (owner,
point, variable, kind, value, source): the point gives the variable a ``constant`` value, a ``copy`` of what the source
was before the point, or something ``varying``. ``entries`` are (owner, point), where every variable varies.

The lattice is unknown, constant, varying. A state holds the points reached and the constants known at them; what is
reached and not known varies, so nothing is held for each pair of point and variable. Each round carries states over
the edges that they leave open and meets them at the edges' ends. Rounds start from the entries alone and only ever open
edges and lose constants, so they end, at the best facts that hold; they work on owners whose state still changes.
A guard is judged after its point's own effect. Owners that fit in one task are worked on there, point by point as states
change, with the same facts; larger ones go by rounds of joins (``owners``).

Cases: rows without an owner or a point take no part; a guard without a value, or whose variable varies, is open both
ways; a point with two unlike effects on a variable makes it vary; an effect of an unknown kind does too; rows that repeat
change nothing; an owner without entries has no states and unreached arms; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graphs import COMPACT
from textloom.operators.owners import walked
from textloom.sources.shared import dropped, kept

_EDGE = ["owner", "src", "dst", "variable", "value", "holds"]
_AT = ["owner", "point"]


def _clean(effects: DataFrame) -> DataFrame:
    """One effect for each owner, point and variable."""
    one = effects.where("owner IS NOT NULL AND point IS NOT NULL AND variable IS NOT NULL").withColumn("what", F.struct("kind", "value", "source"))
    one = one.groupBy(*_AT, "variable").agg(F.min("what").alias("what"), F.max("what").alias("last"))
    kind = F.when(F.col("what").eqNullSafe(F.col("last")), F.col("what.kind"))
    sound = ((kind == "constant") & F.col("what.value").isNotNull()) | ((kind == "copy") & F.col("what.source").isNotNull())
    return one.select(*_AT, "variable", F.when(sound, kind).otherwise("varying").alias("kind"), "what.value", "what.source")


def _after(state: DataFrame, effects: DataFrame) -> DataFrame:
    """owner, src, variable, known: constants when a point has had its effect."""
    known = state.where("variable IS NOT NULL")
    through = known.join(effects, [*_AT, "variable"], "left_anti")
    made = effects.where("kind = 'constant'").join(state.where("variable IS NULL").select(*_AT), _AT, "left_semi").select(*_AT, "variable", "value")
    source = known.select(*_AT, F.col("variable").alias("source"), F.col("value").alias("copied"))
    copied = effects.where("kind = 'copy'").join(source, [*_AT, "source"]).select(*_AT, "variable", F.col("copied").alias("value"))
    return through.unionByName(made).unionByName(copied).select("owner", F.col("point").alias("src"), "variable", F.col("value").alias("known"))


def _judged(state: DataFrame, edges: DataFrame, after: DataFrame) -> DataFrame:
    """Edges out of points that are reached, with what is ``known`` of the guard's variable."""
    reached = state.where("variable IS NULL").select("owner", F.col("point").alias("src"))
    return edges.join(reached, ["owner", "src"], "left_semi").join(after, ["owner", "src", "variable"], "left")


def _open(known: str = "known"):
    return F.coalesce((F.col(known) == F.col("value")) == F.col("holds"), F.lit(True))


def _step(state: DataFrame, edges: DataFrame, effects: DataFrame, entries: DataFrame) -> DataFrame:
    after = _after(state, effects)
    arcs = _judged(state, edges, after).where(_open()).select("owner", "src", F.col("dst").alias("point")).distinct()
    ways = arcs.groupBy(*_AT).agg(F.count("*").alias("ways"))
    met = arcs.join(after, ["owner", "src"]).groupBy(*_AT, "variable").agg(F.count("*").alias("n"), F.min("known").alias("value"), F.max("known").alias("most"))
    same = met.join(ways, _AT).where("n = ways AND value = most").join(entries, _AT, "left_anti").select(*_AT, "variable", "value")
    owners = state.select("owner").distinct()
    reached = ways.select(*_AT).unionByName(entries.join(owners, "owner", "left_semi")).distinct()
    return same.unionByName(reached.select(*_AT, F.lit(None).cast(state.schema["variable"].dataType).alias("variable"), F.lit(None).cast(state.schema["value"].dataType).alias("value")))


def _print(state: DataFrame, name: str) -> DataFrame:
    return state.groupBy("owner").agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64("point", F.col("variable").isNull(), "variable", "value"))).alias(name))


def propagate(edges: DataFrame, effects: DataFrame, entries: DataFrame) -> DataFrame:
    """owner, point, variable, value: the constants before each point's effect; a row with a null variable and value says that
    the point is reached."""
    edges = kept(edges.select(*_EDGE).where("owner IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct())
    effects = kept(_clean(effects))
    entries = kept(entries.select(*_AT).where("owner IS NOT NULL AND point IS NOT NULL").distinct())
    kinds = {f.name: f.dataType for f in effects.schema}
    fields = {"point": entries.schema["point"].dataType} | {k: kinds[k] for k in ("variable", "value")}
    return walked({"edges": edges, "effects": effects, "entries": entries}, fields, _propagate, _propagate_rounds)


def _alike(x, y) -> bool:
    return x == y or x != x and y != y


def _propagate(edges: list[dict], effects: list[dict], entries: list[dict]) -> Iterable[tuple]:
    out, effect = defaultdict(list), defaultdict(list)
    for x in edges:
        out[x["src"]].append(x)
    for x in effects:
        effect[x["point"]].append(x)
    start = {x["point"] for x in entries}
    state: dict = {p: {} for p in start}
    todo = deque(start)
    while todo:
        point = todo.popleft()
        known = state[point]
        after = dict(known)
        for x in effect[point]:
            after.pop(x["variable"], None)
        for x in effect[point]:
            if x["kind"] == "constant":
                after[x["variable"]] = x["value"]
            elif x["kind"] == "copy" and x["source"] in known:
                after[x["variable"]] = known[x["source"]]
        for x in out[point]:
            sure = x["variable"] in after and x["value"] is not None and x["holds"] is not None
            dst = x["dst"]
            if dst in start or sure and _alike(after[x["variable"]], x["value"]) != x["holds"]:
                continue
            old = state.get(dst)
            met = dict(after) if old is None else {k: v for k, v in old.items() if k in after and _alike(after[k], v)}
            if old is None or len(met) < len(old):
                state[dst] = met
                todo.append(dst)
    for point, known in state.items():
        yield point, None, None
        for variable, value in known.items():
            yield point, variable, value


def _propagate_rounds(edges: DataFrame, effects: DataFrame, entries: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in effects.schema}
    state = kept(entries.select(*_AT, F.lit(None).cast(kinds["variable"]).alias("variable"), F.lit(None).cast(kinds["value"]).alias("value")))
    settled: list[DataFrame] = []
    files: list[DataFrame] = [state]
    while True:
        new = kept(_step(state, edges, effects, entries))
        prints = kept(_print(state, "old").join(_print(new, "new"), "owner").select("owner", (F.col("old") == F.col("new")).alias("same")))
        settled.append(new.join(prints.where("same"), "owner", "left_semi"))
        files += [new, prints]
        if prints.where("NOT same").isEmpty():
            return reduce(DataFrame.unionByName, settled)
        state = new.join(prints.where("NOT same"), "owner", "left_semi")
        if len(settled) > COMPACT:
            whole = kept(reduce(DataFrame.unionByName, settled))
            dropped(*files[:-2])  # the newest state is still to be stepped from
            settled, files = [whole], [whole, new, prints]


def arms(edges: DataFrame, effects: DataFrame, state: DataFrame) -> DataFrame:
    """The edges with their ``status``: ``unreached`` if their point is; else ``dead`` or ``always`` if a constant decides a guard;
    else ``open``."""
    edges = edges.select(*_EDGE).where("owner IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct()
    judged = _judged(state, edges, _after(state, _clean(effects)))
    decided = (F.col("known") == F.col("value")) == F.col("holds")
    seen = judged.select(*_EDGE, F.when(decided, "always").when(~decided, "dead").otherwise("open").alias("status"))
    reached = state.where("variable IS NULL").select("owner", F.col("point").alias("src"))
    return seen.unionByName(edges.join(reached, ["owner", "src"], "left_anti").withColumn("status", F.lit("unreached")))


def chains(tests: DataFrame, edges: DataFrame) -> DataFrame:
    """Chains of tests of one variable, each reached by nothing but the failure of the one before it: what one dispatch on
    the variable can stand for.

    ``tests`` are (owner, point, variable, value, hit, miss), one a point. A row for each test: owner, head (the chain's first
    point), place (from 0), point, variable, value, hit, ``repeated`` (an earlier test of the chain has the value, so its arm is
    dead), ``size`` and ``otherwise`` (where the last test's failure goes). Heads are found by jumps that double, so a chain of
    n tests takes log2 n rounds; tests that fail into each other in a circle have no head and are left out."""
    tests = kept(tests.where("owner IS NOT NULL AND point IS NOT NULL").dropDuplicates(_AT))
    ways = edges.where("src IS NOT NULL").select("owner", F.col("dst").alias("point"), "src").distinct().groupBy(*_AT).agg(F.count("*").alias("ways"))
    before = tests.select("owner", F.col("miss").alias("point"), F.col("variable").alias("same"), F.col("point").alias("up")).where("point <> up")
    linked = tests.join(ways.where("ways = 1"), _AT).join(before, _AT).where("variable = same").select(*_AT, "up")
    at = kept(tests.select(*_AT).join(linked, _AT, "left").select(*_AT, "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place")))
    limit = max(1, at.count()).bit_length() + 1
    for _ in range(limit):
        further = at.select("owner", F.col("point").alias("up"), F.col("up").alias("over"), F.col("place").alias("more"))
        jumped = at.join(further, ["owner", "up"], "left")
        to = F.coalesce("over", "up")
        new = kept(jumped.select(*_AT, to.alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("over").isNotNull().alias("moved")))
        dropped(at)
        at = new.select(*_AT, "up", "place")
        if new.where("moved").isEmpty():
            break
    heads = at.where("up IS NULL").select("owner", F.col("point").alias("up")).join(at, ["owner", "up"]).unionByName(at.where("up IS NULL").select("owner", F.col("point").alias("up"), "point", "place"))
    rows = tests.join(heads.withColumnRenamed("up", "head"), _AT)
    chain = rows.groupBy("owner", "head").agg(F.count("*").alias("size"), F.max_by("miss", "place").alias("otherwise"))
    again = F.row_number().over(Window.partitionBy("owner", "head", "value").orderBy("place")) > 1
    rows = rows.withColumn("repeated", again & F.col("value").isNotNull())
    return rows.join(chain, ["owner", "head"]).select("owner", "head", "place", "point", "variable", "value", "hit", "repeated", "size", "otherwise")
