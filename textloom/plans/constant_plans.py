"""Queries of constants and of chains of tests, over each user's events.

For constants, a point is a type and ten of the variables that props name, and a user's events in order are walks from the
entry to the exit. Purchases give their variable a constant, clicks copy one variable to another, errors leave theirs
unknown, and views test theirs: each way out of them has the value that it is taken for. For chains, views are tests one by
one: of one of two variables, going to the user's last event if they hold and to the next event if not.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import constants
from textloom.plans.registry import query, table
from textloom.sources.shared import kept


def _events(spark, d):
    events = table(spark, d, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("owner"), "event_id", "ts", F.coalesce("event_type", F.lit("")).alias("type"), k.alias("k"), F.floor("value").cast("long").alias("v"))


def _program(spark, d):
    """edges, effects and entries of the users' walks."""
    order = Window.partitionBy("owner").orderBy("ts", "event_id")
    slot = F.floor(F.col("k") / 10).cast("long")
    at = _events(spark, d).withColumn("slot", slot).withColumn("point", F.concat_ws("/", "type", F.col("slot").cast("string")))
    at = kept(at.withColumn("src", F.coalesce(F.lag("point").over(order), F.lit(""))).withColumn("last", F.lead("event_id").over(order).isNull()))
    leave = at.where("last").select("owner", F.col("point").alias("src"), F.lit("~").alias("dst"), F.lit(0).cast("long").alias("w"))
    steps = at.select("owner", "src", F.col("point").alias("dst"), (F.col("v") % 3).alias("w")).unionByName(leave).groupBy("owner", "src", "dst").agg(F.min("w").alias("w"))
    test = F.col("src").startswith("view/")
    edges = steps.select("owner", "src", "dst", F.when(test, F.substring_index("src", "/", -1).cast("long")).alias("variable"), F.when(test, F.col("w")).alias("value"), F.when(test, F.lit(True)).alias("holds"))
    points = at.groupBy("owner", "point", "type", "slot").agg(F.min("v").alias("v"))
    kind = F.when(F.col("type") == "purchase", "constant").when(F.col("type") == "click", "copy").when(F.col("type") == "error", "varying")
    effects = points.select("owner", "point", F.col("slot").alias("variable"), kind.alias("kind"), F.when(kind == "constant", F.col("v") % 3).alias("value"), F.when(kind == "copy", F.col("v") % 10).alias("source")).where("kind IS NOT NULL")
    return edges, effects, at.select("owner", F.lit("").alias("point")).distinct()


@query("event_arms")
def _(spark, d):
    """Which ways out of each point of a user's walks constants leave open."""
    edges, effects, entries = map(kept, _program(spark, d))
    return constants.arms(edges, effects, constants.propagate(edges, effects, entries))


_E = """e AS (SELECT user_id AS owner, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS variable, CAST(floor(value) AS BIGINT) % 3 AS value,
  lead(event_id) OVER w AS nxt, lag(event_type) OVER w AS type_before, lag(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2) OVER w AS variable_before,
  last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final, row_number() OVER w AS nth
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("event_dispatches", f"""WITH {_E},
t AS (SELECT *, sum(CASE WHEN type_before = 'view' AND variable_before = variable THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY nth) AS grp FROM e WHERE event_type = 'view' AND nxt IS NOT NULL),
c AS (SELECT *, first_value(event_id) OVER g AS head, row_number() OVER g - 1 AS place, count(*) OVER (PARTITION BY owner, grp) AS size,
  last_value(nxt) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS otherwise, row_number() OVER (PARTITION BY owner, grp, value ORDER BY nth) > 1 AS repeated
  FROM t WINDOW g AS (PARTITION BY owner, grp ORDER BY nth))
SELECT owner, head, place, event_id AS point, variable, value, final AS hit, repeated, size, otherwise FROM c WHERE size >= 2""")
def _(spark, d):
    """Runs of two or more tests of one variable that one dispatch can stand for."""
    order = Window.partitionBy("owner").orderBy("ts", "event_id")
    final = F.last("event_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = kept(_events(spark, d).withColumn("miss", F.lead("event_id").over(order)).withColumn("hit", final).where("miss IS NOT NULL"))
    test = at.where("type = 'view'").select("owner", F.col("event_id").alias("point"), (F.col("k") % 2).alias("variable"), (F.col("v") % 3).alias("value"), "hit", "miss")
    edges = at.select("owner", F.col("event_id").alias("src"), F.col("miss").alias("dst")).unionByName(test.select("owner", F.col("point").alias("src"), F.col("hit").alias("dst")))
    return constants.chains(test, edges).where("size >= 2")
