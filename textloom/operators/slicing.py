"""Slices of dependence graphs, and what can be split because its slices share nothing.

Statements of all owners (functions, sessions) are rows; so are their dependences (owner, src, dst: dst needs src).
Slices grow by one dependence a round for all owners and criteria at once, and only from what is new. Whether slices
share a statement is told by labels that meet at statements, so no pairs of slices are made.

Cases: statements without an order, owner or id take no part; a variable that is null is neither read nor written;
a criterion is in its own slice, also without any dependence; cycles end as nothing in them is new again; rows that
repeat change nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graphs import fixpoint
from textloom.sources.shared import dropped, kept


def last_writes(statements: DataFrame, owner: str, point: str, order: list[str], reads: Column, writes: Column) -> DataFrame:
    """owner, src, dst, variable: the last statement of the owner before dst that writes a variable that dst reads.

    ``reads`` and ``writes`` are arrays. Reads and writes of a variable meet in one window, so a statement is dealt once
    for each of its variables and no two statements are paired."""
    rows = statements.where(F.col(owner).isNotNull() & F.col(point).isNotNull())
    order_at = F.struct(*order, point)
    used = lambda kind, of: rows.select(F.col(owner).alias("owner"), F.col(point).alias("point"), order_at.alias("at"), F.explode(F.array_distinct(of)).alias("variable"), F.lit(kind).alias("kind")).where("variable IS NOT NULL")
    # a statement reads before it writes, so its own write is not before its read
    before = Window.partitionBy("owner", "variable").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.last(F.when(F.col("kind") == 1, F.col("point")), ignorenulls=True).over(before)
    both = used(0, reads).unionByName(used(1, writes)).withColumn("src", wrote)
    return both.where("kind = 0 AND src IS NOT NULL").select("owner", "src", F.col("point").alias("dst"), "variable")


def slices(dependences: DataFrame, criteria: DataFrame, forward: bool = False) -> DataFrame:
    """owner, criterion, point: what each criterion (owner, point) needs, or with ``forward`` what needs it; itself included."""
    back, front = ("src", "dst") if forward else ("dst", "src")
    steps = kept(dependences.select("owner", F.col(back).alias("point"), F.col(front).alias("next")).where("point <> next").distinct())
    seed = criteria.select("owner", F.col("point").alias("criterion"), "point").where("owner IS NOT NULL AND point IS NOT NULL")
    out = fixpoint(seed, lambda new: new.join(steps, ["owner", "point"]).select("owner", "criterion", F.col("next").alias("point")), ["owner", "criterion", "point"])
    return out


def independent_groups(sliced: DataFrame) -> DataFrame:
    """owner, criterion, grp: criteria whose slices share a statement, directly or by others between them, have the same
    group, named by its smallest criterion. Labels fall to the smallest at each statement and back, and jump along
    labels, until none falls."""
    held = kept(sliced.select("owner", "criterion", "point").distinct())
    labels = kept(held.select("owner", "criterion").distinct().withColumn("grp", F.col("criterion")))
    while True:
        at_point = held.join(labels, ["owner", "criterion"]).groupBy("owner", "point").agg(F.min("grp").alias("least"))
        fallen = held.join(at_point, ["owner", "point"]).groupBy("owner", "criterion").agg(F.min("least").alias("least"))
        jump = labels.select("owner", F.col("criterion").alias("least"), F.col("grp").alias("further"))
        lower = fallen.join(jump, ["owner", "least"]).select("owner", "criterion", F.least("least", "further").alias("grp"))
        new = kept(lower.join(labels.withColumnRenamed("grp", "old"), ["owner", "criterion"]).select("owner", "criterion", "grp", "old"))
        done = new.where("grp <> old").isEmpty()
        dropped(labels)
        labels = new.select("owner", "criterion", "grp")
        if done:
            dropped(held)
            return labels


def splits(statements: DataFrame, sliced: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """owner, grp, criteria, statements, first_point, last_point, alone, splittable: the statements that each group of
    criteria needs, and whether the owner falls into independent parts: it has two or more groups of ``least`` statements
    or more. ``alone`` counts the owner's statements that no group needs, which stay where they are."""
    placed = kept(sliced.join(groups, ["owner", "criterion"]).select("owner", "grp", "criterion", "point"))
    by_group = placed.groupBy("owner", "grp").agg(F.count_distinct("criterion").alias("criteria"), F.count_distinct("point").alias("statements"), F.min("point").alias("first_point"), F.max("point").alias("last_point"))
    large = by_group.groupBy("owner").agg(F.sum(F.when(F.col("statements") >= least, 1).otherwise(0)).alias("large"), F.sum("statements").alias("needed"))
    every = statements.where("owner IS NOT NULL AND point IS NOT NULL").groupBy("owner").agg(F.count_distinct("point").alias("all"))
    out = by_group.join(large, "owner").join(every, "owner")
    return out.select("owner", "grp", "criteria", "statements", "first_point", "last_point", (F.col("all") - F.col("needed")).alias("alone"), (F.col("large") >= 2).alias("splittable"))
