"""Streams run over all events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.streaming import feedback


def stream_feedback(spark: SparkSession, root: str) -> DataFrame:
    """(window_start, user_id, hits, boost): windows that are complete, that is, end before the watermark."""
    counts = feedback.windowed_counts(feedback.event_stream(spark, f"{root}/events.parquet"))
    done = feedback.boosts(feedback.run_to_table(counts, "feedback"))
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "user_id", "hits", "boost")


def stream_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """(event_type, n): events once each by event_id within a day."""
    single = feedback.event_stream(spark, f"{root}/events.parquet").withWatermark("at", "24 hours").dropDuplicatesWithinWatermark(["event_id"])
    return feedback.run_to_table(single.select("event_id", "event_type"), "deduped").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_feedback, stream_dedupe)}
SQL = {
    "stream_feedback": """with e as (select distinct on (event_id) * from events), w as (select cast(unnest(range(cast(date_trunc('day', ts) as timestamp) - interval 6 days, date_trunc('day', ts) + interval 1 day, interval 1 day)) as timestamp) as s, * from e),
c as (select s, user_id, count(*) as hits, count(*) filter (event_type = 'purchase') as up, count(*) filter (event_type = 'error') as down from w group by s, user_id)
select strftime(s, '%Y-%m-%d') as window_start, user_id, hits, round(least(2.0, greatest(0.5, 1 + case when hits < 10 then 0.0 else (up - down) / hits * 0.1 end)), 6) as boost from c where s + interval 7 days <= (select max(ts) from events) - interval 24 hours""",
    "stream_dedupe": "select event_type, count(*) as n from (select distinct on (event_id) * from events) group by 1",
}
