"""Streaming queries, each equal to its batch form."""

from pyspark.sql import functions as F

from ..streaming import events as st
from .registry import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def stream_tumbling(spark, d):
    return st.latest(st.windowed(st.read(spark, d, "events"), "1 hour"), ["w_start"])


@query("""SELECT w_start, count(*) AS n, sum(value) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k for k in [0, 1, 2, 3]]) AS w_start FROM events) GROUP BY 1""")
def stream_sliding(spark, d):
    return st.latest(st.windowed(st.read(spark, d, "events"), "1 hour", "15 minutes"), ["w_start"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d):
    return st.latest(st.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type"])


@query("SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_histogram(spark, d):
    return st.latest(st.read(spark, d, "events").where("value IS NOT NULL").groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n")), ["bin"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 30 MINUTE AS w_end, count(*) AS n FROM k GROUP BY user_id, s""")
def stream_sessions(spark, d):
    return st.latest(st.sessions(st.read(spark, d, "events"), "30 minutes"), ["user_id", "w_start"], mode="complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    e = st.read(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return st.latest(e, ["user_id", "event_type"], mode="append")
