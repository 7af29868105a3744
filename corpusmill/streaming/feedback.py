"""Feedback and index events as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import scores
from corpusmill.session import forget_at_exit, shared_dir, ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Files of events as they arrive in the folder ``path``, or the single file there, with a time that a watermark can
    follow."""
    ship(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "24 hours", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """(window_start, user_id, hits, up, down): events once each by event_id, in sliding windows; what comes later than
    ``late`` is dropped, and a window is given out when the watermark passes its end."""
    single = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    counts = single.groupBy(F.window("at", size, slide), "user_id").agg(F.count("*").alias("hits"), F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))
    return counts.select(F.col("window.start").alias("window_start"), "user_id", "hits", "up", "down")


def boosts(counts: DataFrame, least: int = 10) -> DataFrame:
    """Counts with the boost they give."""
    delta = scores.feedback_delta(F.col("hits"), F.col("up"), F.col("down"), least)
    return counts.withColumn("boost", F.round(scores.clamp_boost(1 + delta), 6))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a table of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    forget_at_exit(path, path + "-state")
    query: StreamingQuery = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``state`` with ``changes`` of the same columns: of each key the row with the highest ``order``."""
    from corpusmill.operators.catalog import first_per_group

    return first_per_group(state.unionByName(changes), keys, [F.desc(order)])


def route_batches(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], valid: str, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows for which ``valid`` holds go to ``good``, the others, nulls too, to ``bad``, the
    dead letters. Each batch is written out first, so both see the same rows; a batch that is done again writes over what
    it wrote, by the stream's ``name`` and its number."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{shared_dir(spark)}/corpusmill/{name}/batch-{number}"
        forget_at_exit(path)
        marked = batch.withColumn("_valid", F.coalesce(F.expr(valid), F.lit(False)))
        marked.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(marked.schema).parquet(path)
        good(rows.where("_valid").drop("_valid"), number)
        bad(rows.where("not _valid").drop("_valid"), number)

    return each


def accumulate_boosts(events: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(user_id, boost): a stream of each user's boost after each batch of ``events`` (user_id, event_type): state that
    only its own events change, within [low, high]."""
    import pandas as pd

    def update(key, batches, state):
        boost = state.get[0] if state.exists else 1.0
        for rows in batches:
            delta = 0.01 * ((rows["event_type"] == "purchase").sum() - (rows["event_type"] == "error").sum())
            boost = min(high, max(low, boost + float(delta)))
        state.update((boost,))
        yield pd.DataFrame({"user_id": [key[0]], "boost": [round(boost, 6)]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(update, "user_id long, boost double", "boost double", "update", GroupStateTimeout.NoTimeout)
