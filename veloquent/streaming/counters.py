"""Calendar-window counters and sessions over a stream of request logs: the streaming form of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veloquent.sources import sinks


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_stream(logs: DataFrame, id_col: str = "id", at: str = "created_at", late: str = "7 days") -> DataFrame:
    """Rows delivered again within the watermark count once; state older than that is dropped."""
    return logs.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def window_counts(logs: DataFrame, key: str = "api_key_id", at: str = "created_at", width: str = "1 minute") -> DataFrame:
    """(key, start, n) per tumbling window; append mode emits a window once the watermark has passed it."""
    return logs.groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def session_counts(logs: DataFrame, user: str = "user_id", at: str = "created_at", gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n): sessions by inactivity. The engine closes a session at a gap of exactly the limit,
    one event earlier than the batch operator does, and its end is the last event plus the gap."""
    return logs.filter(F.col(user).isNotNull()).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: str) -> StreamingQuery:
    """Keep the newest row per key in a table of parts (see ``sinks``); a batch replayed after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.upsert_into(batch.sparkSession, path, batch, keys, newest)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
