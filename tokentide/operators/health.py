"""Health summaries of the last seven days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.functions.scalars import FIVE_HOURS, SEVEN_DAYS
from tokentide.operators.pricing import unpriced_models

DAYS = 7


def _recent(df: DataFrame, now) -> DataFrame:
    now = F.lit(now).cast("timestamp")
    return df.where(F.col("timestamp").between(now - F.expr(f"INTERVAL {DAYS} DAYS"), now))


def health_usage(priced: DataFrame, now) -> DataFrame:
    """Usage events found, unpriced ones among them, and `warn` if there are none or some lack a price."""
    row = _recent(priced, now).agg(
        F.count("*").alias("included_usage_events"),
        F.count_if(~F.col("priced")).alias("unpriced_calls"),
        F.coalesce(F.sum(F.when(~F.col("priced"), F.col("total_tokens"))), F.lit(0)).alias("unpriced_tokens"),
    )
    bad = (F.col("included_usage_events") == 0) | (F.col("unpriced_calls") > 0)
    return row.withColumn("status", F.when(bad, "warn").otherwise("ok"))


def health_unpriced(priced: DataFrame, now) -> DataFrame:
    return unpriced_models(_recent(priced, now)).select("pricing_key", "model", "calls", "total_tokens", "note")


def health_quota(samples: DataFrame, now) -> DataFrame:
    row = _recent(samples, now).agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("window_minutes") == FIVE_HOURS).alias("five_hour_samples"),
        F.count_if(F.col("window_minutes") == SEVEN_DAYS).alias("seven_day_samples"),
        F.max("timestamp").alias("latest_observed_at"),
    )
    return row.withColumn("status", F.when(F.col("sample_count") == 0, "warn").otherwise("ok"))
