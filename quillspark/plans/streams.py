"""Windows over events, batch and stream alike (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.base import Queries, table
from quillspark.streaming.windows import sessions, tumbling

Q = Queries()


@Q.add("event_tumbling", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def event_tumbling(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "1 hour").select("window_start", "event_type", "events", F.round("total", 4).alias("total"))


@Q.add("event_sessions", """with g as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval '30 minutes' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
  s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(ts) as session_start, count(*) as events from s group by user_id, sid""")
def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", "session_start", "events")


@Q.add("event_rollup", "select event_type, user_id % 4 as shard, count(*) as events from events group by rollup (event_type, user_id % 4)")
def event_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("shard"))
    return rows.rollup("event_type", "shard").agg(F.count("*").alias("events"))


QUERIES, ORACLES = Q.queries, Q.sql
