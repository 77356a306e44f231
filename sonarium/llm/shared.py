"""What the operators share: stored tables, shuffle files that go early, words, and slices of batches."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sonarium.storage import shared_dir, stored  # noqa: F401  to the operators

#: Words are runs of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more; it goes by the JVM's
    collections, which on an idle driver may be an hour apart."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """The words of a text, as an array; of a null text, none."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def split_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def pieces(batches: Iterable[pa.RecordBatch], budget: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most so many bytes (of at least one row), so that long texts don't add up."""
    for batch in batches:
        rows, step = batch.num_rows, max(1, int(batch.num_rows * budget / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
