"""Queries of slices and independent parts, over each user's events as statements.

An event writes the variable that its props name and reads the one that its value names, so its dependence is the last
event of the user before it that wrote what it reads. Purchases are what is computed. For regions, a point is a type and
ten of such variables, and a user's events in order are a walk from the entry to the exit.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import regions, slicing
from textloom.plans.registry import query, table
from textloom.sources.shared import kept


def _statements(spark, d):
    events = table(spark, d, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    writes = F.get_json_object("props", "$.k").cast("long")
    reads = (F.floor("value") % 100).cast("long")
    return events.select("user_id", "event_id", "ts", "event_type", F.array(reads).alias("reads"), F.array(writes).alias("writes"))


def _dependences(statements):
    return slicing.last_writes(statements, "user_id", "event_id", ["ts"], F.col("reads"), F.col("writes"))


def _criteria(statements, kind):
    return statements.where(F.col("event_type") == kind).select(F.col("user_id").alias("owner"), F.col("event_id").alias("point"))


_DEP = """e AS MATERIALIZED (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS w, CAST(floor(value) AS BIGINT) % 100 AS r FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
dep AS MATERIALIZED (SELECT a.user_id AS owner, arg_max(b.event_id, b.at) AS src, a.event_id AS dst, a.r AS variable FROM e a JOIN e b ON a.user_id = b.user_id AND b.w = a.r AND b.at < a.at GROUP BY ALL)"""
_BACK = "back AS (SELECT user_id AS owner, event_id AS criterion, event_id AS point FROM e WHERE event_type = 'purchase' UNION SELECT back.owner, criterion, src FROM back JOIN dep ON dep.dst = back.point)"


@query("event_dependences", f"WITH {_DEP} SELECT owner, src, dst, variable FROM dep")
def _(spark, d):
    return _dependences(_statements(spark, d))


@query("backward_slices", f"WITH RECURSIVE {_DEP}, {_BACK} SELECT owner, criterion, count(*) AS points, min(point) AS first_point, CAST(sum(point) AS BIGINT) AS sum_of_points FROM back GROUP BY owner, criterion")
def _(spark, d):
    """What each purchase needs."""
    s = _statements(spark, d)
    out = slicing.slices(_dependences(s), _criteria(s, "purchase"))
    return out.groupBy("owner", "criterion").agg(F.count("*").alias("points"), F.min("point").alias("first_point"), F.sum("point").alias("sum_of_points"))


@query("forward_slices", f"""WITH RECURSIVE {_DEP}, fore AS (SELECT user_id AS owner, event_id AS criterion, event_id AS point FROM e WHERE event_type = 'error' UNION SELECT fore.owner, criterion, dst FROM fore JOIN dep ON dep.src = fore.point)
SELECT owner, criterion, count(*) AS points, max(point) AS last_point, CAST(sum(point) AS BIGINT) AS sum_of_points FROM fore GROUP BY owner, criterion""")
def _(spark, d):
    """What each error may have spoilt."""
    s = _statements(spark, d)
    out = slicing.slices(_dependences(s), _criteria(s, "error"), forward=True)
    return out.groupBy("owner", "criterion").agg(F.count("*").alias("points"), F.max("point").alias("last_point"), F.sum("point").alias("sum_of_points"))


@query("independent_splits", f"""WITH RECURSIVE {_DEP}, {_BACK},
meet AS (SELECT owner, criterion AS a, criterion AS b FROM back WHERE criterion = point UNION SELECT m.owner, m.a, y.criterion FROM meet m JOIN back x ON x.criterion = m.b JOIN back y ON y.point = x.point),
g AS (SELECT owner, a AS criterion, min(b) AS grp FROM meet GROUP BY owner, a),
p AS (SELECT g.owner, grp, count(DISTINCT criterion) AS criteria, count(DISTINCT point) AS statements, min(point) AS first_point, max(point) AS last_point FROM g JOIN back USING (owner, criterion) GROUP BY g.owner, grp),
o AS (SELECT owner, count(*) FILTER (statements >= 2) AS large, sum(statements) AS needed FROM p GROUP BY owner),
n AS (SELECT user_id AS owner, count(*) AS every FROM e GROUP BY user_id)
SELECT owner, grp, criteria, statements, first_point, last_point, CAST(every - needed AS BIGINT) AS alone, large >= 2 AS splittable FROM p JOIN o USING (owner) JOIN n USING (owner)""")
def _(spark, d):
    """Groups of purchases that need nothing in common: each user's events fall into as many independent parts."""
    s = kept(_statements(spark, d))
    sliced = kept(slicing.slices(_dependences(s), _criteria(s, "purchase")))
    groups = slicing.independent_groups(sliced)
    return slicing.splits(s.select(F.col("user_id").alias("owner"), F.col("event_id").alias("point")), sliced, groups)


def _walk(statements):
    """owner, src, dst: the steps of each user's events between points, from the entry (an empty name) to the exit ("~")."""
    point = F.concat_ws("/", F.coalesce("event_type", F.lit("")), F.floor(F.get("writes", F.lit(0)) / 10).cast("string"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = statements.select(F.col("user_id").alias("owner"), "event_id", point.alias("dst"), F.coalesce(F.lag(point).over(order), F.lit("")).alias("src"), F.lead("event_id").over(order).isNull().alias("last"))
    leave = at.where("last").select("owner", F.col("dst").alias("src"), F.lit("~").alias("dst"))
    return at, at.select("owner", "src", "dst").unionByName(leave).distinct()


@query("event_regions")
def _(spark, d):
    """Single-entry single-exit regions of each user's walk, how they nest, and what they read from and give to outside."""
    s = kept(_statements(spark, d))
    at, edges = _walk(s)
    found = kept(regions.regions(edges, "", "~"))
    points = kept(regions.region_points(found, edges, "", "~"))
    place = at.select("owner", F.col("event_id").alias("src"), F.col("dst").alias("point"))
    flows = _dependences(s).join(place, ["owner", "src"]).select("owner", F.col("point").alias("from"), "dst", "variable")
    flows = flows.join(place.withColumnRenamed("src", "dst"), ["owner", "dst"]).select("owner", F.col("from").alias("src"), F.col("point").alias("dst"), "variable")
    tree, names = regions.region_tree(points), regions.signatures(points, flows)
    return found.join(tree, ["owner", "region"]).join(names, ["owner", "region"]).drop("region").withColumn("nested", F.col("parent").isNotNull()).drop("parent")
