"""Queries of control flow and data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import flow, metrics
from textloom.plans.registry import query, table
from textloom.sources import corpus, programs



@query("cfg_points")
def _(spark, d):
    return flow.lowered_points(corpus.files(spark))


@query("cfg_edges")
def _(spark, d):
    return flow.lowered_edges(corpus.files(spark))


@query("program_dependences")
def _(spark, d):
    return flow.lowered_edges(corpus.files(spark), dependences=True)


def _programs(spark, d):
    return programs.programs(table(spark, d, "documents"), "doc_id")


@query("control_regions")
def _(spark, d):
    return flow.control_regions(_programs(spark, d))


@query("control_facts")
def _(spark, d):
    return flow.control_facts(_programs(spark, d).unionByName(corpus.modules(spark)))


@query("program_points")
def _(spark, d):
    """Points with dominators, live names and reaching definitions of the functions of as many programs as there are documents."""
    return flow.lowered_points(_programs(spark, d))


_T = "s AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), f AS (SELECT user_id, arg_min(event_type, struct_pack(ts := ts, id := event_id)) AS event_type FROM events GROUP BY user_id), ed AS (SELECT DISTINCT user_id, p.k AS src, q.k AS dst FROM s JOIN ty p ON p.event_type = src JOIN ty q ON q.event_type = dst WHERE dst IS NOT NULL UNION SELECT user_id, 0, k FROM f JOIN ty USING (event_type))"


def _walks(spark, d):
    """Each user's transition graph over numbered event types, from point 0."""
    events = table(spark, d, "events")
    from pyspark.sql import Window

    types = events.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")).cast("long"))
    steps = metrics.transitions(events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "src", "dst")
    t = types
    steps = steps.join(t.toDF("src", "a"), "src").join(t.toDF("dst", "b"), "dst").select("user_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    first = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type")).join(t, "event_type").select("user_id", F.lit(0).cast("long").alias("src"), F.col("k").alias("dst"))
    return steps.unionByName(first).distinct()


@query("event_dominators", f"""WITH RECURSIVE {_T}, pt AS (SELECT DISTINCT user_id, dst AS p FROM ed), av AS (SELECT user_id, p AS x FROM pt),
r AS (SELECT user_id, x, CAST(0 AS BIGINT) AS p FROM av UNION SELECT r.user_id, x, ed.dst FROM r JOIN ed ON ed.user_id = r.user_id AND ed.src = r.p WHERE ed.dst <> x),
dm AS (SELECT a.user_id, pt.p AS point, a.x AS dom FROM av a JOIN pt USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.x = a.x AND r.p = pt.p) UNION ALL SELECT user_id, p, 0 FROM pt),
n AS (SELECT user_id, point, count(*) AS depth FROM dm GROUP BY ALL)
SELECT dm.user_id, dm.point, arg_max(dm.dom, coalesce(k.depth, 1)) FILTER (dm.dom <> dm.point) AS idom, count(*) AS depth FROM dm LEFT JOIN n k ON k.user_id = dm.user_id AND k.point = dm.dom GROUP BY dm.user_id, dm.point
UNION ALL SELECT DISTINCT user_id, 0, CAST(NULL AS BIGINT), 1 FROM ed""")
def _(spark, d):
    """Immediate dominators of every user's graph; SQL finds dominators by leaving each point out and seeing what is cut off."""
    return flow.owner_dominators(_walks(spark, d), "user_id", 0)


@query("event_cycles", f"WITH RECURSIVE {_T}, c AS (SELECT user_id, src, dst FROM ed UNION SELECT c.user_id, c.src, ed.dst FROM c JOIN ed ON ed.user_id = c.user_id AND ed.src = c.dst) SELECT user_id, count(DISTINCT src) AS cyclic_points FROM c WHERE src = dst GROUP BY user_id")
def _(spark, d):
    def run(group):
        import pandas as pd

        after: dict = {}
        for a, b in zip(group["src"], group["dst"], strict=True):
            after.setdefault(int(a), []).append(int(b))
        found = flow.cycles(flow.reach(0, after), after)
        return pd.DataFrame([(group["user_id"].iloc[0], sum(map(len, found)))] if found else [], columns=["user_id", "cyclic_points"])

    return _walks(spark, d).groupBy("user_id").applyInPandas(run, "user_id long, cyclic_points long")


@query("reached_points", f"WITH {_T} SELECT user_id, count(DISTINCT dst) AS reached FROM ed GROUP BY user_id")
def _(spark, d):
    return _walks(spark, d).groupBy("user_id").agg(F.count_distinct("dst").alias("reached"))
