"""Rate cards: the built-in one and JSON files of the same shape."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.schemas import RATE_CARD

# Credits per million input, cached input and output tokens, the
# multiplier of fast mode, and a note, by model key.
BUILT_IN_MODELS = """
('gpt-5.5', 'GPT-5.5', 125.0, 12.5, 750.0, 2.5, NULL),
('gpt-5.4', 'GPT-5.4', 62.5, 6.25, 375.0, 2.0, NULL),
('gpt-5.4-mini', 'GPT-5.4-mini', 18.75, 1.875, 113.0, 1.0, NULL),
('gpt-5.3-codex', 'GPT-5.3-Codex', 43.75, 4.375, 350.0, 1.0, NULL),
('gpt-5.2', 'GPT-5.2', 43.75, 4.375, 350.0, 1.0, NULL),
('gpt-5.3-codex-spark', 'GPT-5.3-Codex-Spark', 0.0, 0.0, 0.0, 1.0, 'research preview; charged at 0 credits'),
('gpt-image-2 (image)', 'GPT-Image-2 (image)', 200.0, 50.0, 750.0, 1.0, NULL),
('gpt-image-2 (text)', 'GPT-Image-2 (text)', 125.0, 31.25, 250.0, 1.0, NULL)
"""
BUILT_IN_CREDIT_TO_USD = "25 credits = $1"
# Rates and multipliers hold six decimals exactly; a card with more is rejected.
DECIMALS = 6
LARGEST_RATE = 1_000_000
LARGEST_MULTIPLIER = 1_000


@dataclass(frozen=True)
class RateCard:
    models: DataFrame  # card_key, label, in_rate, cached_rate, out_rate, fast_mult, note
    known_unpriced: DataFrame  # card_key, label, note
    credits_per_usd: Decimal
    few: bool = False  # a handful of models, known without counting


def credits_per_usd(text: str) -> Decimal:
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s+credits\s+=\s+\$1\s*", text or "")
    if not match or Decimal(match[1]) <= 0:
        raise ValueError(f"credit rate must read 'N credits = $1': {text!r}")
    return Decimal(match[1])


def _typed(models: DataFrame) -> DataFrame:
    return models.select(
        "card_key",
        "label",
        *[F.col(c).cast("decimal(12,6)").alias(c) for c in ("in_rate", "cached_rate", "out_rate")],
        F.col("fast_mult").cast("decimal(9,6)").alias("fast_mult"),
        "note",
    )


def own_card(spark: SparkSession, models: str, rate: str) -> RateCard:
    """A card from SQL rows (key, label, three rates, multiplier, note)."""
    columns = "card_key, label, in_rate, cached_rate, out_rate, fast_mult, note"
    typed = _typed(spark.sql(f"SELECT * FROM VALUES {models} AS t({columns})"))
    unpriced = spark.sql("SELECT card_key, label, note FROM VALUES ('', '', '') AS t(card_key, label, note) WHERE false")
    return RateCard(typed, unpriced, credits_per_usd(rate), few=True)


def built_in(spark: SparkSession) -> RateCard:
    return own_card(spark, BUILT_IN_MODELS, BUILT_IN_CREDIT_TO_USD)


def load(spark: SparkSession, path: str) -> RateCard:
    """Read and validate a card; raises ValueError naming the first broken rule."""
    doc = spark.read.schema(RATE_CARD).json(path, multiLine=True)
    model = F.col("m")
    models = doc.select(F.explode("models").alias("m")).select(
        model["key"].alias("card_key"),
        model["label"].alias("label"),
        model["input_credits_per_million"].alias("in_rate"),
        model["cached_input_credits_per_million"].alias("cached_rate"),
        model["output_credits_per_million"].alias("out_rate"),
        F.coalesce(model["fast_credit_multiplier"], F.lit(1.0)).alias("fast_mult"),
        model["note"].alias("note"),
    )
    unpriced = doc.select(F.explode("knownUnpriced").alias("m")).select(
        model["key"].alias("card_key"), model["label"].alias("label"), model["note"].alias("note")
    )
    text = check(doc, models, unpriced)
    return RateCard(_typed(models), unpriced, credits_per_usd(text))


def check(doc: DataFrame, models: DataFrame, unpriced: DataFrame) -> str:
    """Card rules as aggregates; returns the credit rate text."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_rate = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    fine = lambda c: F.round(F.col(c), DECIMALS) != F.col(c)
    rates = ("in_rate", "cached_rate", "out_rate")
    head = doc.select("source.*").first()
    if head is None or any(not (head[f] or "").strip() for f in ("name", "checked_at", "credit_to_usd")):
        raise ValueError("rate card: source fields cannot be empty")
    got = models.agg(
        F.count("*").alias("n"),
        F.countDistinct("card_key").alias("keys"),
        F.count_if(blank("card_key") | blank("label")).alias("blank"),
        F.count_if(bad_rate("in_rate") | bad_rate("cached_rate") | bad_rate("out_rate")).alias("rates"),
        F.count_if(bad_rate("fast_mult") | (F.col("fast_mult") == 0)).alias("mults"),
        F.count_if(fine("fast_mult") | fine("in_rate") | fine("cached_rate") | fine("out_rate")).alias("fine"),
        F.count_if((F.greatest(*rates) >= LARGEST_RATE) | (F.col("fast_mult") >= LARGEST_MULTIPLIER)).alias("large"),
    ).first()
    none = unpriced.agg(
        F.count("*").alias("n"),
        F.countDistinct("card_key").alias("keys"),
        F.count_if(blank("card_key") | blank("label")).alias("blank"),
    ).first()
    rules = [
        (got.n == 0, "at least one model is needed"),
        (got.blank > 0 or none.blank > 0, "keys and labels cannot be empty"),
        (got.keys < got.n or none.keys < none.n, "duplicate model key"),
        (got.rates > 0, "rates must be finite and non-negative"),
        (got.mults > 0, "fast multipliers must be finite and positive"),
        (got.fine > 0, f"rates and multipliers hold at most {DECIMALS} decimals"),
        (got.large > 0, f"rates are below {LARGEST_RATE}, multipliers below {LARGEST_MULTIPLIER}"),
        (not unpriced.join(models, "card_key", "left_semi").isEmpty(), "a known unpriced model is also priced"),
    ]
    for broken, message in rules:
        if broken:
            raise ValueError(f"rate card: {message}")
    return head["credit_to_usd"]
