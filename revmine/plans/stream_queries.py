"""Plans over streams; each runs until its source is exhausted, and its final state equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import readers, work
from ..streaming import index
from .registry import query


@query("SELECT md5(user_id::STRING || '-' || event_type) AS id, user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that grows by the keys it does not have, fed twice with the same rows."""
    folder = work.shared_folder(spark, "stream-index")
    e = readers.table(spark, sf_dir, "events")
    rows = lambda df: df.select(text.content_key(F.col("user_id"), F.lit("-"), F.col("event_type")).alias("id"), "user_id", "event_type")
    for run in ("first", "again"):
        stream = index.source(spark, f"{sf_dir}/events*.parquet", e)
        index.grow_index(rows(stream), f"{folder}/index", f"{folder}/checkpoint-{run}").awaitTermination()
    return spark.read.parquet(f"{folder}/index")


@query("SELECT user_id AS key, count(*) AS fav_count FROM events WHERE event_type = 'click' GROUP BY user_id")
def stream_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback counters kept by a stream."""
    folder = work.shared_folder(spark, "stream-feedback")
    e = readers.table(spark, sf_dir, "events")
    stream = index.source(spark, f"{sf_dir}/events*.parquet", e).filter("event_type = 'click'")
    index.count_feedback(stream, "user_id", f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return index.latest_counts(spark, f"{folder}/counts")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in hourly windows of event time, with a watermark for late rows."""
    folder = work.shared_folder(spark, "stream-windows")
    e = readers.table(spark, sf_dir, "events")
    counts = index.windowed_counts(index.source(spark, f"{sf_dir}/events*.parquet", e), "ts", "event_type")
    index.keep_changes(counts, f"{folder}/windows", f"{folder}/checkpoint").awaitTermination()
    return index.latest(spark, f"{folder}/windows", "window", "key").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "key", "n")
