"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that the one before has kept, on whole texts. Nulls, empty texts, ties, repeated rows and
further columns are as the operators say; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import mixing, neardup, packing, pii, quality
from sonarium.llm.shared import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail, as all of too few words do; repeated rows are
    judged alike; a null or rare language is compared with all."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. That of the least
    id stays, a null one after all others; of equal rows one; texts without words are one group."""
    return neardup.one_of_each(docs, n=5, similarity=0.8)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars, if there is one, follows the new text (null stays null).
    All rows stay. The key is the session's, or one for synthetic tables."""
    made = pii.with_surrogates(docs, key=pii.key_of(spark, pii.TEST_KEY))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them; a null source is one of its own, and of equal rows
    some may be taken once more than others."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into windows: token ids with their places. Every row is a document of its own; a
    null text is its end alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", rules), ("near-duplicates", near_dedup), ("personal data", surrogates), ("mixture", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
