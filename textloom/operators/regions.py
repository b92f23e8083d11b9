"""Single-entry single-exit regions of flow graphs, and what code of a region needs and gives.

Two edges enclose a region if each cycle of the graph (closed by an edge from exit to entry) has both or neither. That is
told without looking at cycles: in a spanning tree, an edge of the tree is on the cycles that the other edges close
across it, its brackets. Every edge outside the tree gets a random value of 64 bits; a tree edge gets the exclusive
or of its brackets' values, which is that of all ends of such edges below it, as an edge with both ends below cancels
out. Edges of one class have one value, others share one with a probability of about edges squared / 2 ** 64.

Graphs that fit in one task are walked there, so all of them take one shuffle by owner for the classes and one for the
regions' points. Larger ones are rows that go through each step together, with the same results (``owners``): rounds grow with
the depth of the deepest graph, and what is written with the depths of points and the sizes of regions, summed.

Cases: edges without an owner or end, and points that are not on a way from entry to exit, are left out; edges that repeat
are one; an owner without a way to its exit has no regions; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.graphs import fixpoint
from textloom.operators.owners import walked
from textloom.sources.shared import dropped, kept


def on_way(edges: DataFrame, entry, exit_) -> DataFrame:
    """owner, src, dst: the distinct edges on a way from the entry to the exit."""
    e = kept(edges.select("owner", "src", "dst").dropna().distinct())
    owners = e.select("owner").distinct()
    there = fixpoint(owners.withColumn("point", F.lit(entry)), lambda new: new.join(e, (new["owner"] == e["owner"]) & (new["point"] == e["src"])).select(e["owner"], F.col("dst").alias("point")), ["owner", "point"])
    back = fixpoint(owners.withColumn("point", F.lit(exit_)), lambda new: new.join(e, (new["owner"] == e["owner"]) & (new["point"] == e["dst"])).select(e["owner"], F.col("src").alias("point")), ["owner", "point"])
    both = there.join(back, ["owner", "point"])
    return e.join(both.withColumnRenamed("point", "src"), ["owner", "src"], "left_semi").join(both.withColumnRenamed("point", "dst"), ["owner", "dst"], "left_semi").select("owner", "src", "dst")


def _reached(ahead: dict, root) -> set:
    seen, front = {root}, [root]
    while front:
        for x in ahead.get(front.pop(), ()):
            if x not in seen:
                seen.add(x)
                front.append(x)
    return seen


def _on_way(edges: list[dict], entry, exit_) -> list[dict]:
    ahead, behind = defaultdict(list), defaultdict(list)
    for x in edges:
        ahead[x["src"]].append(x["dst"])
        behind[x["dst"]].append(x["src"])
    both = _reached(ahead, entry) & _reached(behind, exit_)
    return [x for x in edges if x["src"] in both and x["dst"] in both]


def _levels_of(start, steps: dict) -> dict:
    """point: (level, up, edge), breadth first by the smallest edge from the level before, as in ``_levels``."""
    found = {start: (0, start, None)}
    front = [start]
    while front:
        new: dict = {}
        for point in front:
            for to, edge in steps.get(point, ()):
                if to not in found and (to not in new or (edge, point) < new[to]):
                    new[to] = (edge, point)
        front = list(new)
        found |= {to: (found[up][0] + 1, up, edge) for to, (edge, up) in new.items()}
    return found


def _classes(edges: list[dict], entry, exit_) -> Iterable[tuple]:
    e = _on_way([x for x in edges if not x["closing"]], entry, exit_)
    if not e:
        return
    steps, ahead = defaultdict(list), defaultdict(list)
    for x in [*e, *(x for x in edges if x["closing"])]:
        if x["src"] != x["dst"]:
            steps[x["src"]].append((x["dst"], x["edge_id"]))
            steps[x["dst"]].append((x["src"], x["edge_id"]))
    for x in e:
        ahead[x["src"]].append((x["dst"], x["edge_id"]))
    tree = _levels_of(entry, steps)
    of_tree = {edge: point for point, (_, _, edge) in tree.items()}
    below = dict.fromkeys(tree, 0)
    for x in edges:
        if x["edge_id"] not in of_tree and x["src"] in tree and x["dst"] in tree and x["src"] != x["dst"]:
            below[x["src"]] ^= x["value"]
            below[x["dst"]] ^= x["value"]
    for point in reversed(tree):  # levels rise in it
        if tree[point][2] is not None:
            below[tree[point][1]] ^= below[point]
    levels = _levels_of(entry, ahead)
    for x in e:
        inner = of_tree.get(x["edge_id"])
        yield x["src"], x["dst"], x["value"] if inner is None else below[inner], levels[x["src"]][0]


def _points(marks: list[dict], edges: list[dict], entry, exit_) -> Iterable[tuple]:
    ahead = defaultdict(list)
    for x in _on_way(edges, entry, exit_):
        ahead[x["src"]].append(x["dst"])
    for m in marks:
        seen, front = {m["point"]}, [m["point"]]
        while front:
            at = front.pop()
            for to in ahead.get(at, ()):
                if to not in seen and (at, to) != (m["exit_src"], m["exit_dst"]):
                    seen.add(to)
                    front.append(to)
        for point in seen:
            yield m["region"], point


def _levels(start: DataFrame, steps: DataFrame) -> DataFrame:
    """Breadth first over ``steps`` (owner, point, next, edge): owner, point, level, up, edge of each point reached, by the
    smallest edge from the level before."""
    front = kept(start.select("owner", "point", F.lit(0).alias("level"), F.col("point").alias("up"), F.lit(None).cast("long").alias("edge")))
    parts = [front]
    while True:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        near = front.join(steps, ["owner", "point"]).select("owner", F.col("next").alias("to"), F.struct("edge_id", F.col("point").alias("up")).alias("by"), "level")
        new = near.groupBy("owner", F.col("to").alias("point")).agg(F.min("by").alias("by"), (F.min("level") + 1).alias("level"))
        front = kept(new.join(every.select("owner", "point"), ["owner", "point"], "left_anti").select("owner", "point", "level", "by.up", F.col("by.edge_id").alias("edge")))
        if front.isEmpty():
            return every
        parts.append(front)
        if len(parts) > 8:
            parts = [kept(every.unionByName(front))]


def edge_classes(edges: DataFrame, entry, exit_, seed: int = 1) -> DataFrame:
    """owner, src, dst, class, level: the edges on a way from entry to exit, equal classes on the same cycles, and how many
    edges the shortest way from the entry to an edge has."""
    e = edges.select("owner", "src", "dst").dropna().distinct().withColumn("closing", F.lit(False))
    closing = e.select("owner").distinct().select("owner", F.lit(exit_).alias("src"), F.lit(entry).alias("dst"), F.lit(True).alias("closing"))
    e = e.unionByName(closing).withColumn("edge_id", F.xxhash64("owner", "src", "dst", "closing"))
    point, number = e.schema["src"].dataType, T.LongType()
    rounds = lambda edges: _class_rounds(edges.where("NOT closing"), entry, exit_, seed)
    tables = {"edges": e.withColumn("value", F.xxhash64("owner", "edge_id", F.lit(seed)))}
    return walked(tables, {"src": point, "dst": point, "class": number, "level": T.IntegerType()}, partial(_classes, entry=entry, exit_=exit_), rounds)


def _class_rounds(edges: DataFrame, entry, exit_, seed: int) -> DataFrame:
    e = on_way(edges, entry, exit_)
    closing = e.select("owner").distinct().select("owner", F.lit(exit_).alias("src"), F.lit(entry).alias("dst"))
    # an edge's number tells only itself from the owner's others
    e = kept(e.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True))).withColumn("edge_id", F.xxhash64("owner", "src", "dst", "closing")))
    open_ = e.where("src <> dst")
    both_ways = open_.select("owner", F.col("src").alias("point"), F.col("dst").alias("next"), "edge_id").unionByName(open_.select("owner", F.col("dst").alias("point"), F.col("src").alias("next"), "edge_id"))
    start = e.select("owner").distinct().withColumn("point", F.lit(entry))
    tree = kept(_levels(start, both_ways))
    value = F.xxhash64("owner", "edge_id", F.lit(seed))
    others = kept(e.join(tree.select("owner", F.col("edge").alias("edge_id")), ["owner", "edge_id"], "left_anti").withColumn("value", value))
    ends = others.where("src <> dst").select("owner", F.explode(F.array("src", "dst")).alias("point"), "value")
    own = tree.select("owner", "point", "up").join(ends.groupBy("owner", "point").agg(F.bit_xor("value").alias("value")), ["owner", "point"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    own = kept(own)
    ups = own.select("owner", "point", "up")
    # every point and the points above it, by steps up the tree
    above = fixpoint(
        own.select("owner", F.col("point").alias("top"), "point"),
        lambda new: new.join(ups.select("owner", F.col("point").alias("top"), F.col("up").alias("higher")), ["owner", "top"]).select("owner", F.col("higher").alias("top"), "point"),
        ["owner", "top", "point"],
    )
    below = above.join(own.select("owner", "point", "value"), ["owner", "point"]).groupBy("owner", F.col("top").alias("point")).agg(F.bit_xor("value").alias("class"))
    of_tree = tree.where("edge IS NOT NULL").join(below, ["owner", "point"]).select("owner", F.col("edge").alias("edge_id"), "class")
    classes = of_tree.unionByName(others.select("owner", "edge_id", F.col("value").alias("class")))
    ahead = e.where("NOT closing").select("owner", F.col("src").alias("point"), F.col("dst").alias("next"), "edge_id")
    levels = _levels(start, ahead).select("owner", F.col("point").alias("src"), "level")
    out = kept(e.where("NOT closing").join(classes, ["owner", "edge_id"]).join(levels, ["owner", "src"]).select("owner", "src", "dst", "class", "level"))
    dropped(e, tree, others, own)
    return out


def regions(edges: DataFrame, entry, exit_) -> DataFrame:
    """owner, region, entry_src, entry_dst, exit_src, exit_dst: the smallest regions, between neighbours of a class.

    A class's edges are on every way of it in one order, so the way from the entry tells it."""
    classes = edge_classes(edges, entry, exit_)
    order = Window.partitionBy("owner", "class").orderBy("level")
    following = F.lead(F.struct("src", "dst")).over(order)
    out = classes.withColumn("after", following).where("after IS NOT NULL")
    return out.select("owner", F.xxhash64("src", "dst", "after").alias("region"), F.col("src").alias("entry_src"), F.col("dst").alias("entry_dst"), F.col("after.src").alias("exit_src"), F.col("after.dst").alias("exit_dst"))


def region_points(found: DataFrame, edges: DataFrame, entry, exit_) -> DataFrame:
    """owner, region, point: what the entry edge leads to, on ways to the exit, before the exit edge is passed."""
    marks = found.select("owner", "region", "exit_src", "exit_dst", F.col("entry_dst").alias("point"))
    ways = edges.select("owner", "src", "dst").dropna().distinct().join(found.select("owner").distinct(), "owner", "left_semi")
    fields = {"region": found.schema["region"].dataType, "point": found.schema["entry_dst"].dataType}
    rounds = lambda marks, edges: _point_rounds(marks, edges, entry, exit_)
    return walked({"marks": marks, "edges": ways}, fields, partial(_points, entry=entry, exit_=exit_), rounds)


def _point_rounds(marks: DataFrame, edges: DataFrame, entry, exit_) -> DataFrame:
    e = kept(on_way(edges, entry, exit_).withColumnRenamed("src", "point"))
    step = lambda new: new.join(e, ["owner", "point"]).where("NOT (point = exit_src AND dst = exit_dst)").select("owner", "region", "exit_src", "exit_dst", F.col("dst").alias("point"))
    return fixpoint(marks, step, ["owner", "region", "point"]).select("owner", "region", "point")


def region_tree(points: DataFrame) -> DataFrame:
    """owner, region, size, parent (the smallest region around it; null if none): regions nest or are apart."""
    p = kept(points)
    sizes = p.groupBy("owner", "region").agg(F.count("*").alias("size"))
    sized = kept(p.join(sizes, ["owner", "region"]))
    one = sized.groupBy("owner", "region", "size").agg(F.min("point").alias("point"))  # a region around it has any of its points
    other = sized.select("owner", "point", F.col("region").alias("parent"), F.col("size").alias("parent_size"))
    around = one.join(other, ["owner", "point"]).where("parent_size > size").groupBy("owner", "region").agg(F.min_by("parent", "parent_size").alias("parent"))
    return sizes.join(around, ["owner", "region"], "left")


def signatures(points: DataFrame, dependences: DataFrame) -> DataFrame:
    """owner, region, parameters, results: the variables that a region's points read from writes outside, and those that
    they write for reads outside, from dependences (owner, src, dst, variable), sorted."""
    p = kept(points)
    here = lambda side: p.withColumnRenamed("point", side)
    into = dependences.join(here("dst"), ["owner", "dst"]).join(here("src"), ["owner", "region", "src"], "left_anti").select("owner", "region", "variable", F.lit(True).alias("into"))
    out = dependences.join(here("src"), ["owner", "src"]).join(here("dst"), ["owner", "region", "dst"], "left_anti").select("owner", "region", "variable", F.lit(False).alias("into"))
    both = into.unionByName(out).groupBy("owner", "region").agg(*[F.array_sort(F.collect_set(F.when(F.col("into") == way, F.col("variable")))).alias(name) for name, way in (("parameters", True), ("results", False))])
    none = F.expr(f"cast(array() as array<{dict(dependences.dtypes)['variable']}>)")
    return p.select("owner", "region").distinct().join(both, ["owner", "region"], "left").select("owner", "region", *[F.coalesce(c, none).alias(c) for c in ("parameters", "results")])
