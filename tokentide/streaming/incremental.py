"""Incremental variants of the batch operators, for logs that keep growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators.usage import measures
from tokentide.sources.logs import path_session_id


def read_line_stream(spark: SparkSession, sessions_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """New log files as a stream of lines (file_path, block, line_no, value).

    The file source emits whole new files and no line order, so this suits reports
    that need none: records with their own usage, and quota samples.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("lineSep", "\n").load(sessions_dir).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.lit(None).cast("bigint").alias("line_no"),
        "value",
    )


def line_usage(events: DataFrame, model: str = "unknown") -> DataFrame:
    """Records from the usage a token line states itself, without state across lines."""
    own = events.where((F.col("event_type") == "event_msg") & (F.col("payload_type") == "token_count"))
    own = own.where(F.col("last_usage").isNotNull() & F.col("timestamp").isNotNull())
    return own.select(
        "timestamp",
        path_session_id(F.element_at(F.split("file_path", "/"), -1), F.col("file_path")).alias("session_id"),
        F.lit(model).alias("model"),
        "last_usage.*",
    )


def usage_by_bucket(priced: DataFrame, bucket: str = "1 hour", late: str = "2 hours", key: str = "model") -> DataFrame:
    """Usage per time bucket and key; a bucket is final once the watermark has passed it.

    Sessions are not counted: an exact distinct would keep every session as state.
    """
    return (
        priced.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", bucket), F.col(key).alias("key"))
        .agg(*measures())
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", *[
            "calls", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens",
            "credits", "priced_calls", "unpriced_calls",
        ])
    )
