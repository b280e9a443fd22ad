"""Condensing chunks through a model: reuse of earlier results, calls for the rest, ordered results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Model = Callable[[str, str, int], str]
ATTEMPTS = 3


def stub_model(title: str, text: str, target: int) -> str:
    """A local stand-in: heading and opening of the chunk, padded to four fifths of the target."""
    out = f"## {title}\n\n{text[: max(0, target - len(title) - 5)].strip()}"
    return out + " ·" * max(0, (target * 4 // 5 - len(out) + 1) // 2)


def inputs(books: DataFrame, pruned: DataFrame) -> DataFrame:
    """books (book_id, text, chapters) as they are condensed: with the pruned text where there is one, and with the chapters
    as they stand after pruning if any is left; a book without pruned text keeps its own.

    pruned: book_id, pruned_text, pruned_chapters. Chapters travel in their books' rows, so one join does.
    """
    stored = pruned.select("book_id", F.col("pruned_text").alias("_text"), F.col("pruned_chapters").alias("_chapters"))
    both = books.join(stored, "book_id", "left")
    chapters = F.when(F.size("_chapters") > 0, F.col("_chapters")).otherwise(F.col("chapters"))
    return both.withColumn("text", F.coalesce("_text", "text")).withColumn("chapters", chapters).drop("_text", "_chapters")


def reusable(chunks: DataFrame, ledger: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with ``reused``: the checkpoint's text, else the cache's, if its length suits; null where a call is due.

    ledger: task_id is the caller's concern; unit_id, cache_key, status, text. cache: cache_key, text.
    The cache isn't asked where a checkpoint has a text.
    """
    done = ledger.where("status = 'done' and text <> ''").select("book_id", "unit_id", F.col("cache_key").alias("_key"), F.col("text").alias("_checkpoint"))
    held = cache.where("text <> ''").select("cache_key", F.col("text").alias("_cached"))
    both = chunks.join(done, ["book_id", "unit_id"], "left").join(held, "cache_key", "left")
    candidate = F.coalesce(F.when(F.col("_key") == F.col("cache_key"), F.col("_checkpoint")), F.col("_cached"))
    fits = T.length_issue(F.length(candidate), F.col("chunk_target")) == ""
    return both.withColumn("reused", F.when(fits, candidate)).drop("_key", "_checkpoint", "_cached")


def condense(chunks: DataFrame, model: Model = stub_model) -> DataFrame:
    """book_id, unit_ix, chunk_ix, unit_id, cache_key, output, attempts, error of the chunks that need a call.

    A call is repeated, up to ATTEMPTS times, while the output's length doesn't suit. A unit's
    chunks are worked through in order, by one task, and the first that fails ends the unit: no
    call is made for those after it, and they get no row; other units go on. Persist the result
    before using it: a model's answers are neither free nor repeatable.
    """
    due = chunks.select("book_id", "unit_ix", "chunk_ix", "unit_id", "cache_key", "title", "chunk_target", "chunk_text")
    due = due.repartition("book_id", "unit_ix").sortWithinPartitions("book_id", "unit_ix", "chunk_ix")
    names = ["book_id", "unit_ix", "chunk_ix", "unit_id", "cache_key"]

    def answer(title: str, target: int, text: str) -> tuple[str, int, str]:
        """Output, attempts and what is wrong with the last one."""
        out, problem, n = "", "", 0
        for n in range(1, ATTEMPTS + 1):  # noqa: B007
            try:
                out, problem = model(title, text, target), ""
            except Exception as failed:  # the model is foreign code: its failure is the chunk's, not the job's
                return "", n, str(failed) or type(failed).__name__
            if len(out) > max(2 * target, target + 500):
                problem = "long"
            elif len(out) < 0.75 * target:
                problem = "short"
            else:
                break
        return out, n, problem

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = None  # the unit that a failure has ended, carried from batch to batch
        for batch in batches:
            asked, answers = [], []
            for i, (book, unit, title, target, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("book_id", "unit_ix", "title", "chunk_target", "chunk_text")), strict=True)):
                if (book, unit) == ended:
                    continue
                asked.append(i)
                answers.append(answer(title, target, text))
                if answers[-1][2]:
                    ended = (book, unit)
            kept = batch.take(pa.array(asked, pa.int64()))
            columns = [pa.array([a[k] for a in answers], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), *columns], [*names, "output", "attempts", "error"])

    kind = due.schema["book_id"].dataType.simpleString()
    return due.mapInArrow(call, f"book_id {kind}, unit_ix int, chunk_ix int, unit_id string, cache_key string, output string, attempts int, error string")


def merged(outputs: DataFrame) -> DataFrame:
    """book_id, output, n_units, n_errors: chunk texts joined by blank lines, in order, up to a unit's first error."""
    failed = F.min(F.when(F.col("error") != "", F.col("chunk_ix")))
    per_unit = outputs.groupBy("book_id", "unit_ix").agg(failed.alias("_bad"), F.array_sort(F.collect_list(F.struct("chunk_ix", "output"))).alias("_parts"))
    kept = F.filter("_parts", lambda p: F.col("_bad").isNull() | (p["chunk_ix"] < F.col("_bad")))
    texts = per_unit.select("book_id", "unit_ix", F.array_join(F.transform(kept, lambda p: p["output"]), "\n\n").alias("unit_text"), F.col("_bad").isNotNull().cast("int").alias("_failed"))
    ordered = F.array_sort(F.collect_list(F.when(T.word_count(F.col("unit_text")) > 0, F.struct("unit_ix", "unit_text"))))
    return texts.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda u: u["unit_text"]), "\n\n").alias("output"), F.count("*").alias("n_units"), F.sum("_failed").alias("n_errors"))
