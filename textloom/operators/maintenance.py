"""What is reached, kept up to date as edges come and go, by work that grows with the change.

A state is (owner, node, level): every node but the roots has an edge from a reached node of a lower level, which supports it.
A removed edge makes its target a candidate; a candidate without a support left is lost for now and makes candidates of the
higher nodes that it led to. Levels fall along supports, so nodes of a cycle cannot support each other once the way to the cycle is gone. What is
lost is then derived again from what stayed, together with what new edges reach, at levels above their sources.

Owners that fit in one task are searched there; larger ones go by rounds of joins, with the same results (``owners``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graphs import COMPACT, fixpoint
from textloom.operators.owners import walked
from textloom.sources.shared import dropped, kept

_NODE = ["owner", "node"]


def _from(edges: DataFrame) -> DataFrame:
    return edges.select("owner", F.col("a").alias("node"), F.col("b").alias("next"))


def _into(edges: DataFrame) -> DataFrame:
    return edges.select("owner", F.col("b").alias("node"), F.col("a").alias("source"))


def _fields(*columns: str, of: DataFrame) -> dict:
    return {c: of.schema[c].dataType for c in columns}


def _spread_from(seed: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """``seed`` (owner, node, level) and what it reaches over ``edges`` outside ``known``, each node at the level at which it was first found."""
    some = seed.select("owner").distinct()
    of_seed = lambda df, *c: df.select("owner", *c).join(some, "owner", "left_semi")
    tables = {"seed": seed.select(*_NODE, "level"), "edges": of_seed(edges, "a", "b").where("a IS NOT NULL"), "known": of_seed(known, "node")}
    return walked(tables, _fields("node", "level", of=seed), _spread, _spread_rounds)


def _spread(seed: list[dict], edges: list[dict], known: list[dict]) -> Iterable[tuple]:
    ahead, seen = defaultdict(list), {x["node"] for x in known}
    for x in edges:
        ahead[x["a"]].append(x["b"])
    front: dict = {}
    for x in seed:
        front[x["node"]] = min(x["level"], front.get(x["node"], x["level"]))
    found = dict(front)
    while front:
        new: dict = {}
        for node, level in front.items():
            for b in ahead.get(node, ()):
                if b not in seen and b not in found:
                    new[b] = min(level + 1, new.get(b, level + 1))
        found |= new
        front = new
    return found.items()


def _spread_rounds(seed: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    lowest = lambda df: df.groupBy(*_NODE).agg(F.min("level").alias("level"))

    def step(new: DataFrame) -> DataFrame:
        ahead = new.join(_from(edges), _NODE).select("owner", F.col("next").alias("node"), (F.col("level") + 1).alias("level"))
        return lowest(ahead).join(known.select(_NODE), _NODE, "left_anti")

    return fixpoint(lowest(seed), step, _NODE)


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The state of ``edges`` (owner, a, b) from ``roots`` (owner, node), which are at level 0. Nulls reach nothing."""
    seed = roots.dropna(subset=_NODE).select("owner", "node", F.lit(0).cast("long").alias("level"))
    return _spread_from(seed, edges.select("owner", "a", "b").distinct(), seed.limit(0))


def unsupported(state: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The nodes (owner, node, level) of ``state`` that nothing of a lower level supports once ``edges`` have lost ``removed``. Each round looks at
    the edges into its candidates alone, and owners that lose none are left out."""
    some = removed.select("owner").distinct()
    of_removed = lambda df, *c: df.select("owner", *c).dropna().join(some, "owner", "left_semi")
    ends = ["a", "b"]
    tables = {"state": of_removed(state, "node", "level"), "edges": of_removed(edges, *ends), "removed": removed.select("owner", *ends).dropna()}
    return walked(tables, _fields("node", "level", of=state), _unsupported, _unsupported_rounds)


def _unsupported(state: list[dict], edges: list[dict], removed: list[dict]) -> Iterable[tuple]:
    level = {x["node"]: x["level"] for x in state}
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in {(x["a"], x["b"]) for x in edges} - {(x["a"], x["b"]) for x in removed}:
        ahead[a].append(b)
        behind[b].append(a)
    candidates, lost = {x["b"] for x in removed if level.get(x["b"], 0) > 0}, set()
    while candidates:
        new = {b for b in candidates if not any(a not in lost and a in level and level[a] < level[b] for a in behind.get(b, ()))}
        lost |= new
        candidates = {b for a in new for b in ahead.get(a, ()) if b not in lost and level.get(b, 0) > level[a]}
    return [(x, level[x]) for x in lost]


def _unsupported_rounds(state: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    left = edges.join(removed, ["owner", "a", "b"], "left_anti")
    place = state.where("level > 0")
    candidates = kept(removed.select("owner", F.col("b").alias("node")).distinct().join(place, _NODE))
    lost, parts = candidates.limit(0), []
    while not candidates.isEmpty():
        standing = state.select("owner", F.col("node").alias("source"), F.col("level").alias("below")).join(lost.select("owner", F.col("node").alias("source")), ["owner", "source"], "left_anti")
        held = candidates.join(_into(left), _NODE).join(standing, ["owner", "source"]).where("below < level").select(_NODE).distinct()
        new = kept(candidates.join(held, _NODE, "left_anti"))
        lost = lost.unionByName(new)
        parts.append(new)
        if len(parts) > COMPACT:
            lost = kept(lost)
            dropped(*parts[:-1])
            parts = [lost, new]
        # A node that is looked at again, as it has lost another support, was held before and is not lost yet.
        ahead = new.select("owner", "node", F.col("level").alias("from")).join(_from(left), _NODE).select("owner", F.col("next").alias("node"), "from")
        candidates = kept(ahead.join(place, _NODE).where("level > from").select("owner", "node", "level").distinct().join(lost, _NODE, "left_anti"))
    return lost


def updated(state: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state after the change, and what it lost and gained. ``state`` is that of ``edges``; edges that are both removed and
    added stay, removed ones that are not there change nothing, and repeated ones count once."""
    keys = ["owner", "a", "b"]
    edges, added = edges.select(keys).distinct(), added.select(keys).distinct()
    gone = kept(removed.select(keys).distinct().join(edges, keys, "left_semi").join(added, keys, "left_anti"))
    after = kept(edges.join(gone, keys, "left_anti").unionByName(added).distinct())
    lost = kept(unsupported(state, edges, gone))
    stays = state.join(lost, _NODE, "left_anti")
    source = stays.select("owner", F.col("node").alias("a"), "level")
    again = after.join(lost.select("owner", F.col("node").alias("b")), ["owner", "b"]).select(keys)
    entries = again.unionByName(added).distinct().join(source, ["owner", "a"]).select("owner", F.col("b").alias("node"), (F.col("level") + 1).alias("level"))
    fresh = _spread_from(entries.join(stays.select(_NODE), _NODE, "left_anti"), after, stays)
    return stays.unionByName(fresh), lost.select(_NODE).join(fresh, _NODE, "left_anti"), fresh.select(_NODE).join(lost, _NODE, "left_anti")
