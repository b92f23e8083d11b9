"""Queries of graphs that change and graphs that are alike, over each user's events as a walk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import colours, maintenance
from textloom.plans.registry import query, table
from textloom.sources.shared import kept


def _walks(spark, d, point):
    """owner, a, b and k of each step of the users' walks; a is null at the first event."""
    events = table(spark, d, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("owner").orderBy("ts", "event_id")
    at = events.select(F.col("user_id").alias("owner"), "ts", "event_id", F.coalesce("event_type", F.lit("")).alias("type"), k.alias("k"))
    return at.withColumn("b", point).withColumn("a", F.lag("b").over(order)).select("owner", "a", "b", "k")


_W = """SELECT user_id AS owner, lag({0}) OVER w AS a, {0} AS b, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_SLOT = "concat_ws('/', coalesce(event_type, ''), CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS VARCHAR))"


@query("event_maintenance", f"""WITH RECURSIVE w AS MATERIALIZED ({_W.format(_SLOT)}),
e AS MATERIALIZED (SELECT owner, a, b, bool_or(coalesce(k % 20, -1) <> 0) AS old, bool_or(coalesce(k % 20, -1) <> 1) AS new FROM w WHERE a IS NOT NULL GROUP BY ALL),
o AS (SELECT owner, b AS node FROM w WHERE a IS NULL UNION SELECT o.owner, e.b FROM o JOIN e ON e.owner = o.owner AND e.a = o.node AND e.old),
n AS (SELECT owner, b AS node FROM w WHERE a IS NULL UNION SELECT n.owner, e.b FROM n JOIN e ON e.owner = n.owner AND e.a = n.node AND e.new)
SELECT coalesce(o.owner, n.owner) AS owner, coalesce(o.node, n.node) AS node, CASE WHEN n.owner IS NULL THEN 'lost' WHEN o.owner IS NULL THEN 'gained' ELSE 'kept' END AS status
FROM o FULL JOIN n ON o.owner = n.owner AND o.node = n.node""")
def _(spark, d):
    """What each user's walk reaches before and after a change: steps that only events whose number is 0 by 20 made come, those that only 1 by 20 made go."""
    slot = F.floor(F.col("k") / 25).cast("string")
    walks = kept(_walks(spark, d, F.concat_ws("/", "type", slot)))
    rest = F.coalesce(F.col("k") % 20, F.lit(-1))
    steps = kept(walks.where("a IS NOT NULL").groupBy("owner", "a", "b").agg(F.bool_or(rest != 0).alias("old"), F.bool_or(rest != 1).alias("new")))
    old = steps.where("old")
    state = maintenance.reached(old, walks.where("a IS NULL").select("owner", F.col("b").alias("node")))
    after, lost, gained = maintenance.updated(state, old, steps.where("old AND NOT new"), steps.where("new AND NOT old"))
    stays = after.select("owner", "node").join(gained, ["owner", "node"], "left_anti")
    rows = lambda df, status: df.select("owner", "node", F.lit(status).alias("status"))
    return rows(stays, "kept").unionByName(rows(lost, "lost")).unionByName(rows(gained, "gained"))


def _rounds(n: int) -> str:
    """n rounds of refinement in SQL, where a colour is a digest of what is around."""
    step = """c{0} AS MATERIALIZED (SELECT c.owner, c.node, md5(c.colour || '>' || coalesce((SELECT string_agg(x.colour, ',' ORDER BY x.colour) FROM e JOIN c{1} x ON x.owner = e.owner AND x.node = e.b WHERE e.owner = c.owner AND e.a = c.node), '')
  || '<' || coalesce((SELECT string_agg(x.colour, ',' ORDER BY x.colour) FROM e JOIN c{1} x ON x.owner = e.owner AND x.node = e.a WHERE e.owner = c.owner AND e.b = c.node), '')) AS colour FROM c{1} c)"""
    return ",\n".join(step.format(k, k - 1) for k in range(1, n + 1))


@query("event_topologies", f"""WITH w AS ({_W.format("coalesce(event_type, '')")}), e AS MATERIALIZED (SELECT DISTINCT owner, a, b FROM w WHERE a IS NOT NULL),
c0 AS (SELECT DISTINCT owner, b AS node, '' AS colour FROM w), {_rounds(6)},
g AS (SELECT owner, string_agg(colour, ',' ORDER BY colour) AS form, count(*) AS nodes, count(DISTINCT colour) AS colours FROM c6 GROUP BY owner)
SELECT owner, min(owner) OVER (PARTITION BY form) AS class, nodes, colours, nodes = colours AS proven FROM g""")
def _(spark, d):
    """Users whose walks between types of events are alike but for the types' names. There are five types, so six rounds settle every graph in SQL."""
    walks = kept(_walks(spark, d, F.col("type")))
    nodes = walks.select("owner", F.col("b").alias("node"), F.lit(None).cast("string").alias("label")).distinct()
    edges = walks.where("a IS NOT NULL").select("owner", "a", "b", F.lit(None).cast("string").alias("label")).distinct()
    return colours.topologies(nodes, edges)
