"""Contiguous shards of equal bytes, by global prefix sums cut at equal targets.

Law: ``bytes``. The rows are put in one global order (the text's checksum and size, then id), in
which equal texts are neighbours, so a group of them falls into one shard, or, if it is too large
for one or lies across a cut, into shards that follow each other. Their sizes are summed ahead of each row, and row i goes to the shard that holds the middle of
its bytes: floor(shards * (before + size / 2) / total). So shards are contiguous in the order,
and each differs from total / shards by less than the largest row.

Defined results: a null text has size 1; of equal texts null ids come first; repeated rows are neighbours and
may be told apart by slot only; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals

SHARDS = 16


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1) and text_crc32: all that the cut needs of a text."""
    return docs.select(
        *carried,
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def shard(rows: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("text_crc32", "size", "doc_id"), size: str = "size") -> DataFrame:
    """rows with shard (int), slot (long, gapless from 0) and law."""
    summed = running_totals(rows, list(order), size)
    number = F.least(F.lit(shards - 1), F.expr(f"((2 * before + `{size}`) * {shards}) div (2 * total)")).cast("int")
    summed = summed.withColumn("shard", number)
    first = summed.groupBy("shard").agg(F.min("at").alias("_first"))  # one row per shard
    return (
        summed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("at") - F.col("_first"))
        .withColumn("law", F.lit("bytes"))
        .drop("_first", "at", "before", "total")
    )


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
