"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is given a place in a fixed shuffle (the MD5 of its id), and its
virtual finish time is the source's cumulative words up to its end divided by the source's
weight. A source may be passed over up to three times; later passes go on counting. All copies
are range-sorted by finish time and truncated at the total budget, the sum of all sizes. At the
time where the budget ends each source has had weight * time words or all its copies, which is
just the level to which the targets are filled when excess is shared anew by weight.

Defined results: a null text has size 0; a null source is a source of its own, the last in
order; null ids shuffle as ''; rows with one id and source are told apart by checksum and size,
equal rows stay neighbours; a source of no words has target 0 and nothing taken; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .prefix import running_totals

#: Fixed values of the contract.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: A source's rows are summed in buckets of the shuffle, so that no window holds a whole source.
BUCKET_DIGITS = 3
#: A table of at most so many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select(
        *carried,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target, one row per source.

    Filled by level: with sources in order of limit / weight, the level that a source would set
    is (budget left by the sources before it) / (weight left); the first source whose own
    ratio isn't below that level fixes it. Sources meet in one place, a row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("_rank", F.lit(len(WEIGHTS))))
    limit = (F.col("source_size") * MOST_PASSES).cast("double")
    by_ratio = Window.orderBy("_ratio", "_rank")
    ahead, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        ranked.withColumn("weight", weight)
        .withColumn("_limit", limit)
        .withColumn("_ratio", F.col("_limit") / F.col("weight"))
        .withColumn("_left", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_limit").over(ahead), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
        .withColumn("_own", F.col("_left") / F.col("_weights"))
        .withColumn("_level", F.min(F.when(F.col("_own") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_own"))).over(whole)["_own"])
        .withColumn("target", F.least("_limit", F.col("_level") * F.col("weight")))
        .select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def mix(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size, ...) with source_size, target, passes (how often it is taken) and taken."""
    rows = cut(
        sizes.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
        .withColumn("_place", F.monotonically_increasing_id())
    )
    targets = cut(source_targets(rows))
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "_crc", "size", "_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_in", F.sum("size").over(inside))
    both = summed.join(offsets.withColumnsRenamed({"source": "_s", "_bucket": "_b"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    copies = both.select(
        "_place",
        "_key",
        "size",
        F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))).alias("_pass"),
        ((F.col("_pass") * F.col("source_size") + F.col("_offset") + F.col("_in")).cast("double") / F.col("weight")).alias("_finish"),
    )
    queue = running_totals(copies, ["_finish", "_key", "_place", "_pass"], "size")
    budget = F.col("total").cast("double") / MOST_PASSES
    taken = queue.where(F.col("before") + F.col("size") <= budget).groupBy("_place").agg(F.count("*").cast("int").alias("passes"))
    kept = [c for c in sizes.columns if c not in ("passes", "taken", "source_size", "target")]
    done = rows.join(taken, "_place", "left")
    of_source = targets.withColumnRenamed("source", "_s").drop("weight")
    if targets.count() <= BROADCAST_SOURCES:
        of_source = F.broadcast(of_source)
    done = done.join(of_source, done["source"].eqNullSafe(F.col("_s")))
    passes = F.coalesce("passes", F.lit(0))
    return done.select(*kept, "source_size", "target", passes.alias("passes"), (passes * F.col("size")).cast("long").alias("taken"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", "source")
