"""Parallel sorting by regular sampling: exact ranks over a total order of integer keys.

Every partition's rows are sorted where they are and written as a run. Rows at regular distances in
each run are the samples; at regular distances in the sorted samples lie the splitters. Every row's
segment follows from the splitters, the rows of a segment go to one task by its number, where the
pieces of the runs are merged, and the counts of the segments before it give each row's rank.

With r runs and p segments of n rows in all no segment has more than (n / p) * (1 + r / SAMPLES)
rows, as each run adds at most one sample's distance beyond its samples; runs that aren't sorted
alike by chance come far closer to n / p. The driver holds the samples (MAX_SEGMENTS * SAMPLES rows
of keys at most) and a count for each segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, task_count

#: Samples for each segment.
SAMPLES = 64
#: Rows that a segment is meant for, and the most segments.
SEGMENT_ROWS, MAX_SEGMENTS = 1 << 20, 1 << 14

_IN_RUN = (1 << 33) - 1


def _columns(batch, keys: list[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in keys]


def segments(rows: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each row the number of splitters at or before it; rows and splitters as columns of keys, the first weighs most."""
    n, m = len(rows[0]), len(splitters[0])
    both = [np.concatenate([s, r]) for s, r in zip(splitters, rows, strict=True)]
    order = np.lexsort([np.repeat([0, 1], [m, n]), *both[::-1]])
    out = np.empty(n + m, dtype=np.int64)
    out[order] = np.cumsum(order < m)
    return out[m:]


def _splitters(runs: DataFrame, keys: list[str], rows: int, count: int) -> list[np.ndarray]:
    apart = max(1, rows // (count * SAMPLES))
    run, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(_IN_RUN))
    taken = runs.where(F.pmod(place + F.xxhash64(run), F.lit(apart)) == 0).select(*keys).toArrow()  # about count * SAMPLES rows
    sample = _columns(taken, keys)
    order = np.lexsort(sample[::-1])
    at = order[np.arange(1, count) * len(order) // count] if len(order) else order
    return [c[at] for c in sample]


def ranked(rows: DataFrame, keys: list[str], limit: Callable[[DataFrame], int] | None = None) -> DataFrame:
    """rows with ``rank``: 1, 2, 3 ... by ``keys`` (long, no nulls), null beyond the limit.

    The limit is asked of the written rows. Rows of equal keys are ranked in the order of the runs. Segments that begin beyond the limit aren't exchanged. No
    column of rows may be named _at, _segment or rank; an empty frame gives an empty one.
    """
    spark = rows.sparkSession
    runs = cut(rows.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    order = [*keys, "_at"]
    n = runs.count()
    most = n if limit is None else limit(runs)
    count = min(max(task_count(spark), -(-n // SEGMENT_ROWS)), MAX_SEGMENTS)
    splitters = _splitters(runs, order, n, count)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(_columns(batch, order), splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], [*batch.schema.names, "_segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    tagged = runs.mapInArrow(tag, f"{schema}, _segment int")
    held = tagged.groupBy("_segment").count().toArrow().to_pydict()  # a row for each segment
    sizes = np.zeros(count, dtype=np.int64)
    sizes[held["_segment"]] = held["count"]
    before = np.cumsum(sizes) - sizes
    last = int(np.searchsorted(before, most, side="left"))  # the first segment of which nothing is wanted
    merged = tagged.where(F.col("_segment") < last).repartitionById(max(count, 1), F.col("_segment")).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_RUN)) + 1
    ahead = F.broadcast(spark.createDataFrame(pa.table({"_segment": np.arange(count, dtype=np.int32), "_before": before})))  # a row for each segment
    rank = F.col("_before") + F.col("_place")
    wanted = merged.withColumn("_place", place).join(ahead, "_segment").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))
    rest = tagged.where(F.col("_segment") >= last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return wanted.unionByName(rest)
