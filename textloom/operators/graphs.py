"""Graphs as edge tables (a, b): closures, components, layers, paths and architecture facts.

``fixpoint`` writes each round to the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.shared import dropped, kept


#: Rounds after which what was found is written as one table again, so plans stay short.
COMPACT = 8
#: Graphs of so many edges at most fit in one task.
SMALL = 50_000


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None = None) -> DataFrame:
    """Rows of ``seed`` and all that ``step`` derives from new rows, each key once (semi-naive), until none is new. An error
    if ``most`` rounds do not reach that."""
    new = kept(seed.dropDuplicates(keys))
    every, parts = new, [new]
    for done in itertools.count():
        new = kept(step(new).dropDuplicates(keys).join(every, keys, "left_anti"))
        if new.isEmpty():
            return every
        if done == most:
            raise RuntimeError(f"no fixpoint after {most} rounds")
        every = every.unionByName(new)
        parts.append(new)
        if len(parts) > COMPACT:
            every = kept(every)
            dropped(*parts[:-1])  # the newest part is still to be stepped from
            parts = [every]


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): b is reached from a in one step or more."""
    e = edges.select("a", "b").distinct()
    return fixpoint(e, lambda new: new.join(e.toDF("b", "c"), "b").select("a", F.col("c").alias("b")), ["a", "b"])


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots and all they reach."""
    e = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct()
    return fixpoint(roots.select("node"), lambda new: new.join(e, "node").select(F.col("next").alias("node")), ["node"])


def distances(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, distance within ``depth`` steps, and whether it has neighbours that the depth cut off."""
    e = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct()
    found = kept(roots.select("node", F.lit(0).alias("distance")).distinct())
    front = found
    for k in range(1, depth + 1):
        front = kept(front.join(e, "node").select(F.col("next").alias("node")).distinct().join(found, "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    beyond = found.where(F.col("distance") == depth).join(e, "node").join(found.select(F.col("node").alias("next")), "next", "left_anti").select("node").distinct().withColumn("truncated", F.lit(True))
    return found.join(beyond, "node", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node): labels fall along edges and jump along labels until none falls."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jumped = lower.join(labels.toDF("label", "further"), "label").select("node", "old", F.least("label", "further").alias("label"))
        jumped = kept(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), size, cyclic. A graph of ``SMALL`` edges at most is one task; a larger one is
    coloured: trees that lead in or out go first, each other node takes the smallest one that reaches it, and what reaches that
    node back within its colour is its component. No pairs are made; rounds grow with the longest path that is in no tree."""
    e = kept(edges.where("a <> b").select("a", "b").distinct())
    if e.limit(SMALL + 1).count() <= SMALL:
        found = _components_of_small(e)
    else:
        found = _coloured(e)
    own = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    size = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(size, "component").select("node", "component", "size", (F.col("size") > 1).alias("cyclic"))


def _components_of_small(edges: DataFrame) -> DataFrame:
    """node, component of the nodes on cycles of a graph that fits in one task, by two depth-first walks."""
    kind = dict(edges.dtypes)["a"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        before: dict = {}
        for a, b in zip(group["a"], group["b"], strict=True):
            after.setdefault(a, []).append(b)
            before.setdefault(b, []).append(a)
        order, seen = [], set()
        for root in after:
            stack = [(root, iter(after[root]))] if root not in seen else []
            seen.add(root)
            while stack:
                node, rest = stack[-1]
                nxt = next((x for x in rest if x not in seen), None)
                if nxt is None:
                    order.append(node)
                    stack.pop()
                else:
                    seen.add(nxt)
                    stack.append((nxt, iter(after.get(nxt, ()))))
        rows, placed = [], set()
        for root in reversed(order):
            if root in placed:
                continue
            part, stack = [], [root]
            placed.add(root)
            while stack:
                node = stack.pop()
                part.append(node)
                for x in before.get(node, ()):
                    if x not in placed:
                        placed.add(x)
                        stack.append(x)
            if len(part) > 1:
                least = min(part)
                rows += [(x, least) for x in part]
        return pd.DataFrame(rows, columns=["node", "component"])

    return edges.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, f"node {kind}, component {kind}")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, component of the nodes on cycles, by colours."""
    done = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    left = edges
    while True:
        had = None
        while (n := left.count()) and n != had:  # trees that lead out or in are on no cycle
            had = n
            turned = _without_trees(_without_trees(left).select(F.col("b").alias("a"), F.col("a").alias("b")))
            left = turned.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if left.isEmpty():
            return done
        colour = kept(left.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = left.join(colour.toDF("a", "c"), "a").groupBy(F.col("b").alias("node")).agg(F.min("c").alias("near"))
            after = kept(colour.join(near, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", F.coalesce("near", "colour")).alias("colour")))
            changed = not after.where("colour <> old").isEmpty()
            dropped(colour)
            colour = after.select("node", "colour")
            if not changed:
                break
        same = kept(left.join(colour.toDF("a", "x"), "a").join(colour.toDF("b", "y"), "b").where("x = y").select("a", "b"))
        roots = colour.where("node = colour").select("node", F.col("colour").alias("component"))
        back = same.select(F.col("b").alias("node"), F.col("a").alias("next"))
        found = kept(fixpoint(roots, lambda new, back=back: new.join(back, "node").select(F.col("next").alias("node"), "component"), ["node"]))
        done = kept(done.unionByName(found))
        gone = found.select("node")
        left = kept(left.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"))


def _ends_of_chains(edges: DataFrame) -> tuple[DataFrame, bool]:
    """node, to, w of each node with one way out in ``edges`` (a, b, w; each a and b once): the first node on its way that has none or
    several, and the sum of w up to there, by jumps that double; ``more`` where it has not come to one. And whether some have not,
    as they lead into cycles."""
    one = edges.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("to"), F.max("w").alias("w")).where("n = 1")
    state = kept(one.select(F.col("a").alias("node"), "to", "w", F.lit(True).alias("more")))
    for _ in range(state.count().bit_length() + 1):
        there = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("w").alias("further"))
        after = state.join(there, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("further", F.lit(0))).alias("w"), F.col("next").isNotNull().alias("more"))
        after = kept(after)
        dropped(state)
        state = after
        if state.where("more").isEmpty():
            return state, False
    return state, True


def _without_trees(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without the nodes that have no way out and those whose only way leads to such a node, however long it is."""
    ends, _ = _ends_of_chains(edges.withColumn("w", F.lit(0)))
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.col("a").alias("node"))
    stay = several.unionByName(ends.where("more").select("node")).unionByName(ends.where("NOT more").join(several.select(F.col("node").alias("to")), "to", "left_semi").select("node"))
    return kept(edges.join(stay.toDF("a"), "a", "left_semi").join(stay.toDF("b"), "b", "left_semi").select("a", "b"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """from_, to_, n, sources: edges between different components, with their number and the nodes they come from."""
    c = components.select("node", "component")
    e = edges.join(c.toDF("a", "from_"), "a").join(c.toDF("b", "to_"), "b").where("from_ <> to_")
    return e.groupBy("from_", "to_").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("a")).alias("sources"))


def layers(components: DataFrame, condensed: DataFrame) -> DataFrame:
    """component, layer: 0 for those with no way out, else one more than the highest they lead to. An error if ``condensed``
    has a cycle. A graph of ``SMALL`` edges at most is one task; of a larger one, nodes with one way out are left to the end of
    their chain, in rounds that grow with the logarithm of its length, until what remains is small or has no such nodes. That goes
    by rounds, which grow with its highest layer."""
    nodes = components.select("component").distinct()
    edges = kept(condensed.select(F.col("from_").alias("a"), F.col("to_").alias("b")).distinct().withColumn("w", F.lit(1)))
    chains = []
    while edges.limit(SMALL + 1).count() > SMALL:
        ends, endless = _ends_of_chains(edges)
        if endless:
            raise ValueError(_CYCLE)
        if ends.isEmpty():
            break
        chains.append(ends)
        rest = edges.join(ends.select(F.col("node").alias("a")), "a", "left_anti").join(ends.select(F.col("node").alias("b"), "to", F.col("w").alias("further")), "b", "left")
        edges = kept(rest.select("a", F.coalesce("to", "b").alias("b"), (F.col("w") + F.coalesce("further", F.lit(0))).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w")))
    placed = _layers_of_small(edges) if edges.limit(SMALL + 1).count() <= SMALL else _layers_by_rounds(edges)
    for ends in reversed(chains):
        placed = kept(placed)
        onto = ends.join(placed.select(F.col("component").alias("to"), "layer"), "to", "left").select(F.col("node").alias("component"), (F.col("w") + F.coalesce("layer", F.lit(0))).alias("layer"))
        placed = placed.unionByName(onto)
    return nodes.join(placed, "component", "left").select("component", F.coalesce("layer", F.lit(0)).cast("int").alias("layer"))


_CYCLE = "edges between components have a cycle"


def _layers_by_rounds(edges: DataFrame) -> DataFrame:
    """component, layer of the nodes with edges (a, b, w): the greatest sum of w on a way, one step a round."""
    state = kept(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("component"), F.lit(0).alias("layer")))
    for _ in range(state.count() + 1):
        up = edges.join(state.toDF("b", "below"), "b").groupBy(F.col("a").alias("component")).agg(F.max(F.col("below") + F.col("w")).alias("up"))
        after = kept(state.join(up, "component", "left").select("component", F.col("layer").alias("old"), F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer")))
        dropped(state)
        state = after.select("component", "layer")
        if after.where("layer <> old").isEmpty():
            return state
    raise ValueError(_CYCLE)


def _layers_of_small(edges: DataFrame) -> DataFrame:
    """component, layer of the nodes with edges (a, b, w; each a and b once) of a graph that fits in one task: those without a way
    out that is still open are placed, one after another."""
    kind = dict(edges.dtypes)["a"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        into: dict = {}
        open_: dict = {}
        for a, b, w in zip(group["a"], group["b"], group["w"], strict=True):
            into.setdefault(b, []).append((a, w))
            open_[a] = open_.get(a, 0) + 1
        front = [b for b in into if b not in open_]
        layer = dict.fromkeys(front, 0)
        while front:
            nxt = []
            for b in front:
                for a, w in into.get(b, ()):
                    open_[a] -= 1
                    layer[a] = max(layer.get(a, 0), layer[b] + w)
                    if not open_[a]:
                        nxt.append(a)
            front = nxt
        if any(open_.values()):
            raise ValueError(_CYCLE)
        return pd.DataFrame(list(layer.items()), columns=["component", "layer"])

    return edges.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, f"component {kind}, layer int")


def shortest_paths(edges: DataFrame, root) -> DataFrame:
    """node, distance, path: shortest, and of those the first in order of its nodes."""
    e = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct()
    found = front = kept(edges.sparkSession.createDataFrame([(root, 0, [root])], f"node {dict(edges.dtypes)['a']}, distance int, path array<{dict(edges.dtypes)['a']}>"))
    while True:
        step = front.join(e, "node").select(F.col("next").alias("node"), F.col("distance") + 1, F.concat("path", F.array("next")).alias("path")).toDF("node", "distance", "path")
        front = kept(step.groupBy("node").agg(F.min("distance").alias("distance"), F.min("path").alias("path")).join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def instability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out (distinct others), instability = out / (in + out), null where there are none."""
    e = edges.where("a <> b").select("a", "b").distinct()
    out, into = e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o")), e.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i"))
    both = nodes.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("i", F.lit(0)).alias("fan_in"), F.coalesce("o", F.lit(0)).alias("fan_out"))
    total = F.col("fan_in") + F.col("fan_out")
    return both.withColumn("instability", F.round(F.when(total > 0, F.col("fan_out") / total), 6))


def lifted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the parents of two nodes where they differ: from_, to_, evidence (number of edges)."""
    return edges.join(parents.toDF("a", "from_"), "a").join(parents.toDF("b", "to_"), "b").where("from_ <> to_").groupBy("from_", "to_").agg(F.count("*").alias("evidence"))


def module_profiles(files: DataFrame, edges: DataFrame) -> DataFrame:
    """module, files, internal, outgoing, incoming, cohesion_num, cohesion_den: dependencies inside and across modules."""
    m = files.select("node", "module")
    e = edges.where("a <> b").select("a", "b").distinct().join(m.toDF("a", "from_"), "a").join(m.toDF("b", "to_"), "b")
    inner = e.where("from_ = to_").groupBy(F.col("from_").alias("module")).agg(F.count("*").alias("internal"))
    out, into = (e.where("from_ <> to_").groupBy(F.col(c).alias("module")).agg(F.count("*").alias(n)) for c, n in (("from_", "outgoing"), ("to_", "incoming")))
    size = m.groupBy("module").agg(F.count("*").alias("files"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = size.join(inner, "module", "left").join(out, "module", "left").join(into, "module", "left").select("module", "files", z("internal"), z("outgoing"), z("incoming"))
    return rows.withColumn("cohesion_num", F.when(F.col("files") > 1, F.col("internal"))).withColumn("cohesion_den", F.when(F.col("files") > 1, F.col("files") * (F.col("files") - 1)))


def restructurings(files: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, subject, target: move a file to the module it has more edges with, split a module of several parts, merge
    modules that depend on each other."""
    m = files.select("node", "module")
    size = m.groupBy("module").agg(F.count("*").alias("files"))
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("a", "b")
    ties = both.join(m.toDF("a", "own"), "a").join(m.toDF("b", "other"), "b").groupBy("a", "own", "other").agg(F.count("*").alias("n"))
    home = ties.where("own = other").select("a", F.col("n").alias("at_home"))
    move = ties.where("own <> other").join(home, "a", "left").where("n > coalesce(at_home, 0)").join(size.toDF("own", "files"), "own").where("files > 1").select(F.lit("move").alias("kind"), F.col("a").cast("string").alias("subject"), F.col("other").cast("string").alias("target"))
    inner = edges.join(m.toDF("a", "x"), "a").join(m.toDF("b", "y"), "b").where("x = y AND a <> b").select("a", "b")
    parts = weak_components(m.select("node"), inner).join(m, "node").groupBy("module").agg(F.count_distinct("component").alias("n")).where("n > 1")
    split = parts.select(F.lit("split").alias("kind"), F.col("module").cast("string").alias("subject"), F.col("n").cast("string").alias("target"))
    across = lifted(edges, m).select("from_", "to_")
    merge = across.join(across.toDF("to_", "from_"), ["from_", "to_"]).where("from_ < to_").select(F.lit("merge").alias("kind"), F.col("from_").cast("string").alias("subject"), F.col("to_").cast("string").alias("target"))
    return move.unionByName(split).unionByName(merge)


def seam_ranks(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside cyclic components, cheapest to cut first: by api, then flow, then ends."""
    c = components.where("cyclic").select("node", "component")
    e = edges.join(c.toDF("a", "component"), "a").join(c.toDF("b", "other"), "b").where("component = other AND a <> b")
    w = Window.partitionBy("component").orderBy("api", "flow", "a", "b")
    return e.select("component", "a", "b", "api", "flow", F.row_number().over(w).alias("rank"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """Inclusive and exclusive sums over a forest of (node, parent, value, reset): a reset node ends what its ancestors sum."""
    up = nodes.where("parent IS NOT NULL AND NOT reset").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    reach = closure(up).union(nodes.select("node", "node")).toDF("node", "above")
    sums = reach.join(nodes.select("node", "value"), "node").groupBy(F.col("above").alias("node")).agg(F.sum("value").alias("inclusive"))
    return nodes.select("node", F.col("value").alias("exclusive")).join(sums, "node")
