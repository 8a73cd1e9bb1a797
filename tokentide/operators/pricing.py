"""Rate-card lookup and credit arithmetic (exact decimals)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions.scalars import CREDIT, normalize_model, pricing_key
from tokentide.session import broadcast_if_small
from tokentide.sources.ratecard import RateCard, built_in

# With rates of six decimals, a record's credits keep twelve decimals in 38 digits.
TOKEN = "decimal(16,0)"


def _tokens(name: str) -> Column:
    return F.greatest(F.col(name), F.lit(0))


def price(df: DataFrame, card: RateCard | None = None, mode: str = "fast") -> DataFrame:
    """Adds priced, pricing_label, billable/cached input, credit_multiplier and three credit columns.

    `credits` follows the record's mode, `normal_credits` and `fast_credits` ignore it.
    The card is broadcast if it is the built-in one or counted as small; a larger one is joined by a shuffle.
    """
    card = card or built_in(df.sparkSession)
    cached = F.least(_tokens("cached_input_tokens"), _tokens("input_tokens"))
    billable = _tokens("input_tokens") - cached
    per_million = (
        billable.cast(TOKEN) * F.col("in_rate")
        + cached.cast(TOKEN) * F.col("cached_rate")
        + _tokens("output_tokens").cast(TOKEN) * F.col("out_rate")
    ) * F.lit(Decimal("0.000001"))
    normal = per_million.cast("decimal(28,12)")
    is_fast = F.coalesce(F.col(mode), F.lit(False)) if mode in df.columns else F.lit(False)
    zero = F.lit(Decimal(0)).cast(CREDIT)
    models = card.models.drop("note")
    models = F.broadcast(models) if card.few else broadcast_if_small(models)
    joined = df.withColumn("card_key", pricing_key("model")).join(
        models, "card_key", "left"
    )
    return (
        joined.withColumn("priced", F.col("label").isNotNull())
        .withColumn("pricing_label", F.coalesce("label", "model"))
        .withColumn("billable_input_tokens", billable)
        .withColumn("billed_cached_tokens", cached)
        .withColumn("normal_credits", F.coalesce(normal.cast(CREDIT), zero))
        .withColumn("fast_credits", F.coalesce((normal * F.col("fast_mult")).cast(CREDIT), zero))
        .withColumn("credits", F.when(is_fast, F.col("fast_credits")).otherwise(F.col("normal_credits")))
        .withColumn(
            "credit_multiplier",
            F.when(F.col("priced") & is_fast, F.col("fast_mult").cast("double")).otherwise(F.lit(1.0)),
        )
        .drop("card_key", "label", "in_rate", "cached_rate", "out_rate", "fast_mult")
    )


def unpriced_models(priced: DataFrame) -> DataFrame:
    """One row per unpriced model name: first spelling, calls, tokens, and a card stub to fill in."""
    rows = (
        priced.where(~F.col("priced"))
        .withColumn("pricing_key", normalize_model("model"))
        .groupBy("pricing_key")
        .agg(
            F.min_by("model", F.struct("file_path", "line_no")).alias("model"),
            F.count("*").alias("calls"),
            F.sum("total_tokens").alias("total_tokens"),
        )
    )
    escaped = F.replace(F.replace("model", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rates = ("input_credits_per_million", "cached_input_credits_per_million", "output_credits_per_million")
    stub = F.concat(
        F.lit('{\n  "key": "'), F.col("pricing_key"), F.lit('",\n  "label": "'), escaped, F.lit('"'),
        F.lit("".join(f',\n  "{r}": 0' for r in rates) + "\n}"),
    )
    return (
        rows.withColumn("note", F.lit(None).cast("string"))
        .withColumn("pricing_stub", stub)
        .orderBy(F.desc("calls"), F.desc("total_tokens"), "pricing_key")
    )


def inventory(card: RateCard) -> DataFrame:
    """Priced and known-unpriced models of a card, sorted by key within each list."""
    rates = [F.col(c).cast("double").alias(c) for c in ("in_rate", "cached_rate", "out_rate", "fast_mult")]
    priced = card.models.select(F.lit("priced").alias("status"), "card_key", "label", *rates, "note")
    none = [F.lit(None).cast("double").alias(c) for c in ("in_rate", "cached_rate", "out_rate", "fast_mult")]
    unpriced = card.known_unpriced.select(F.lit("known_unpriced").alias("status"), "card_key", "label", *none, "note")
    return priced.unionByName(unpriced).orderBy(F.desc("status"), "card_key")
