"""From raw documents to token ids: five stages, each on all that the stage before has kept.

A null text passes the stages that keep it and becomes an empty list of ids; columns besides those of `documents` are passed on
by all stages but the last; an empty table gives an empty result; rows that repeat an id and a text are kept or go
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm import bpe, decontaminate, jaccard, pseudonyms, quality
from tokentide.llm.queries import PII_KEY, vocabulary
from tokentide.llm.tables import table
from tokentide.session import ship_code, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and boilerplate lines of the others."""
    ship_code(spark)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    ship_code(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_code(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses get pseudonyms; `n_chars` follows the text."""
    count = "_" * (1 + max(map(len, docs.columns)))
    found = pseudonyms.replaced(docs, PII_KEY, count_col=count)
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, ids, n_tokens, round_trip) of every document."""
    ship_code(spark)
    found = bpe.encoded(docs, *vocabulary())
    return found.select(
        "doc_id",
        "text",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("byte-level BPE", token_ids),
]

# SQL can't express the Feistel network and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline{k}")
    return docs
