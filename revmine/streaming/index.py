"""Streams: an index that grows by the rows it does not have, and feedback counters.

Every micro-batch is deduplicated by key and anti-joined with the index that is there, so a batch that is
replayed after a failure adds nothing. Counters keep one row of state a key and write the changed ones only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def source(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A folder (or a pattern of paths) of Parquet files as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def grow_index(stream: DataFrame, index: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append what the index at a path does not have yet; runs until the source is exhausted."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            known = batch.sparkSession.read.schema(batch.schema).parquet(index)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            known = batch.limit(0)
        ingest.not_indexed(batch, known, key).write.mode("append").parquet(index)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_counts(events: DataFrame, key: str) -> DataFrame:
    """(key, fav_count) of a stream or a table of feedback events."""
    return events.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("fav_count"))


def keep_changes(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the rows that a stream of aggregates changes: a folder at the path for each batch, written over if the batch is replayed. Runs until the source is exhausted."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row of each key among all changes; maxima are combined before the shuffle."""
    whole = spark.read.parquet(path)
    values = [c for c in whole.columns if c not in (*keys, "batch")]
    return whole.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def count_feedback(events: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counters of a stream at a path, each batch with the counters that it changed."""
    return keep_changes(feedback_counts(events, key), path, checkpoint)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark, path, "key")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a key in tumbling windows of event time; rows later than ``late`` are dropped, and a window's state with them (in update or append mode)."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
