"""Queries on streams of events; each is checked against its result over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.registry import query
from inkwell.streaming import streams as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = S.read_stream(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


_EDGE = "(SELECT max(ts) FROM events)"


@query(
    "stream_tumbling",
    f"""SELECT strftime(CAST(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 1 HOUR <= CAST({_EDGE} AS TIMESTAMP) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def _tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_available(S.tumbling(_events(spark, d), "ts", "1 hour", "10 minutes", ["event_type"], "value"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.deduplicate(_events(spark, d), ["event_id"], "ts", "30 minutes").select("event_id"))


@query(
    "stream_session",
    f"""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, CASE WHEN CAST(ts AS TIMESTAMP) < lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(t) + INTERVAL 30 MINUTE <= CAST({_EDGE} AS TIMESTAMP) - INTERVAL 10 MINUTE""",
)
def _session(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_available(S.sessions(_events(spark, d), "ts", "30 minutes", "10 minutes", ["user_id"]))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "stream_decayed",
    f"""WITH t AS (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS day, event_type, sum(value) AS total FROM events GROUP BY ALL)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, round(total * pow(2.0, -((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(day)) / 86400000000.0) / 30.0), 6) AS decayed
    FROM t WHERE day + INTERVAL 1 DAY <= CAST({_EDGE} AS TIMESTAMP) - INTERVAL 1 DAY""",
)
def _decayed(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-31T00:00:00Z").cast("timestamp")
    out = S.run_available(S.decayed(_events(spark, d), "ts", "1 day", ["event_type"], "value", as_of))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", F.round("decayed", 6).alias("decayed"))


@query("stream_union", "SELECT event_id, event_type FROM events")
def _union(spark: SparkSession, d: str) -> DataFrame:
    """Two streams, of one kind of event and of all others, side by side."""
    kind = F.col("event_type") == "click"
    both = S.union_streams(_events(spark, d).where(kind), _events(spark, d).where(~kind | kind.isNull()))
    return S.run_available(both.select("event_id", "event_type"))
