"""Importance resampling towards a target corpus by hashed word runs.

Runs of 1 to ``grams`` words of every text are hashed to buckets and counted over the whole corpus
and over the target. A bucket's gain is the logarithm of its likelihood ratio in thousandths; a
document's weight is the mean gain of its runs, looked up in an array. Noise of a Gumbel
distribution, fixed by the id, is added, and the largest scores are drawn: a sample without
replacement in proportion to the weights. Ranks come from a sort by regular sampling.

Defined results: a null text has no words, weight 0 and is never drawn; a null id hashes as the
empty text and stands last among equal scores; rows of one id have the same noise, and of equal
scores the one of fewer runs comes first; without a target all gains follow from the corpus alone;
an empty table gives an empty result. Words may be of any length, and texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NOT_ALNUM, Tokenizer, text_runs
from .regular import ranked

BUCKETS = 10_000
GRAMS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes up to which words are hashed side by side; a longer word is hashed by itself.
LONG = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    """The table of the reversed polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_states(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 states after bytes start to end of each span, from the states before them."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    begin, left, out = start[order], length[order], state[order]
    long = int(np.searchsorted(-left, -LONG, side="left"))
    for i in range(long):  # few, by far
        out[i] = np.uint32(zlib.crc32(data[begin[i] : begin[i] + left[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
    begin, left, live = begin[long:], left[long:], out[long:]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # spans longer than k stand first
        s = live[:n]
        live[:n] = (s >> np.uint32(8)) ^ _CRC[(s ^ data[begin[:n] + k]) & np.uint32(255)]
    result = np.empty_like(out)
    result[order] = out
    return result


def features(data: np.ndarray, offsets: np.ndarray, tokenizer: Tokenizer, grams: int = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words in turn: the text and the bucket of each; data: UTF-8 bytes of the texts between the offsets."""
    data = _LOWER[data]
    start, end, doc = tokenizer.spans(data, offsets)
    first = np.arange(len(start))
    state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for g in range(grams):
        if g:  # the run goes on with a space and its next word, if the text has one
            first, state = first[: np.searchsorted(first, len(doc) - g)], state[: np.searchsorted(first, len(doc) - g)]
            inside = doc[first] == doc[first + g]
            first, state = first[inside], state[inside]
            state = (state >> np.uint32(8)) ^ _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)]
        state = crc_states(data, start[first + g], end[first + g], state)
        yield doc[first], ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame, grams: int = GRAMS) -> np.ndarray:
    """How many runs of texts (text) fall into each bucket; a task adds up its own before anything is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, counts = Tokenizer(NOT_ALNUM), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text")):
                for _, bucket in features(data, offsets, tokenizer, grams):
                    counts += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(apply, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed likelihood ratio, rounded down."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.floor(1000 * np.log((target + 1) * s / ((corpus + 1) * t))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """docs (doc_id, text) with n_words, n_features and weight in place of the text."""
    rows = docs.select("doc_id", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(NOT_ALNUM)
        for batch in batches:
            n = len(batch)
            words, runs, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for i, j, data, offsets in text_runs(batch.column("text")):
                for g, (doc, bucket) in enumerate(features(data, offsets, tokenizer, grams)):
                    count = np.bincount(doc, minlength=j - i)
                    words[i:j] += count * (g == 0)
                    runs[i:j] += count
                    total[i:j] += np.bincount(doc, weights=gain[bucket], minlength=j - i).astype(np.int64)  # whole numbers, far below 2**53
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(runs), pa.array(total // np.maximum(runs, 1))], ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of docs (doc_id, text) against target (text).

    Of the documents of least_words words or more, percent in a hundred are drawn.
    """
    rows = weighed(docs, gains(bucket_counts(docs, grams), bucket_counts(target, grams)), grams)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = rows.withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = scored.withColumn("_low", -F.col("score")).withColumn("_null", F.col("doc_id").isNull().cast("long")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    scored = scored.withColumn("_short", (F.col("n_words") < least_words).cast("long"))
    # Documents that can't be drawn stand last in the order, so they need no frame of their own.
    out = ranked(scored, ["_short", "_low", "_null", "_id", "n_features"], lambda runs: runs.where("_short = 0").count() * percent // 100)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
