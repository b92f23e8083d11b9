"""Graphs compared by topology: colours refined in rounds of aggregation, and owners of equal graphs put into classes.

A round gives each node a hash of its colour and of the sums over its edges of hashes of their labels and far ends' colours. Sums do not
depend on order and combine before they are shuffled, so a node with many edges is no hot group. An owner leaves the rounds once its
number of colours stands still; two owners of equal graphs do so in the same round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.shared import dropped, kept


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _total(value: Column) -> Column:
    """Sums of 64-bit hashes that wrap instead of failing: halves are summed apart, so there is room for 2^31 edges."""
    return _hash(F.sum(F.shiftrightunsigned(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))))


def refined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """owner, node, colour and rounds, from ``nodes`` (owner, node, label) and ``edges`` (owner, a, b, label). A null label is one
    of its own; repeated nodes take the least label; repeated edges count each; edges from or to a node that is not there are left out, as are null owners and nodes."""
    start = nodes.dropna(subset=["owner", "node"]).groupBy("owner", "node").agg(F.min("label").alias("label"))
    now = kept(start.select("owner", "node", _hash(F.lit("node"), F.col("label")).alias("colour")))
    there = now.select("owner", F.col("node").alias("a"))
    live = kept(edges.select("owner", "a", "b", "label").join(there, ["owner", "a"], "left_semi").join(there.withColumnRenamed("a", "b"), ["owner", "b"], "left_semi"))
    done, held, rounds = None, [], 0
    while not now.isEmpty():
        rounds += 1
        far = now.withColumnRenamed("colour", "far")
        out = live.join(far.withColumnRenamed("node", "b"), ["owner", "b"]).select("owner", F.col("a").alias("node"), _hash(F.lit("out"), "label", "far").alias("seen"))
        into = live.join(far.withColumnRenamed("node", "a"), ["owner", "a"]).select("owner", F.col("b").alias("node"), _hash(F.lit("in"), "label", "far").alias("seen"))
        around = out.unionByName(into).groupBy("owner", "node").agg(_total(F.col("seen")).alias("seen"))
        after = kept(now.join(around, ["owner", "node"], "left").select("owner", "node", F.col("colour").alias("before"), _hash("colour", "seen").alias("colour")))
        counts = after.groupBy("owner").agg((F.count_distinct("before") == F.count_distinct("colour")).alias("settled"))
        still = kept(counts.where("settled").select("owner"))
        rest = after.join(still, "owner", "left_semi").select("owner", "node", "colour", F.lit(rounds).alias("rounds"))
        part = kept(rest)
        held.append(part)
        done = part if done is None else done.unionByName(part)
        if len(held) > 8:
            done = kept(done)
            dropped(*held)
            held = [done]
        before, now = now, kept(after.join(still, "owner", "left_anti").select("owner", "node", "colour"))
        old, live = live, kept(live.join(still, "owner", "left_anti"))
        dropped(before, old, after)
    return done if done is not None else now.withColumn("rounds", F.lit(0))


def topologies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """owner, class (the least owner of the same topology), nodes, colours and ``proven``. Owners of one class have graphs that refinement cannot
    tell apart. Where every node has a colour of its own, colours pair the nodes of two owners, so equal edges between colours, counted
    over the class and never owner by owner, prove that the graphs are equal but for names; ``proven`` is false where colours repeat or an edge differs."""
    colours = kept(refined(nodes, edges))
    sums = colours.groupBy("owner", "rounds").agg(F.count("*").alias("nodes"), F.count_distinct("colour").alias("colours"), _total(_hash("colour")).alias("one"), _total(_hash("colour", F.lit(1))).alias("two"))
    bucket = ["rounds", "nodes", "colours", "one", "two"]
    heads = sums.groupBy(*bucket).agg(F.min("owner").alias("class"), F.count("*").alias("members"))
    owners = kept(sums.join(heads, bucket).select("owner", "class", "members", "nodes", "colours"))
    own = owners.where("nodes = colours").select("owner", "class", "members")
    ends = colours.join(own, "owner")
    one = edges.groupBy("owner", "a", "b", "label").agg(F.count("*").alias("times"))
    one = one.join(ends.select("owner", F.col("node").alias("a"), F.col("colour").alias("from"), "class", "members"), ["owner", "a"])
    one = one.join(ends.select("owner", F.col("node").alias("b"), F.col("colour").alias("to")), ["owner", "b"])
    differ = one.groupBy("class", "members", "from", "to", "label", "times").agg(F.count("*").alias("n")).where("n <> members").select("class").distinct()
    doubt = differ.withColumn("differs", F.lit(True))
    proven = (F.col("nodes") == F.col("colours")) & F.col("differs").isNull()
    return owners.join(doubt, "class", "left").select("owner", "class", "nodes", "colours", proven.alias("proven"))
