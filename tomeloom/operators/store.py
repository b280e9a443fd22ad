"""Stored prune results: tables written in runs, of which readers see whole ones only, and what pruning asks of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prune

CHAPTERS = "array<struct<title:string,level:int,start_char:long,end_char:long>>"


class Runs:
    """Rows by key, written run by run: a run replaces the rows of its keys and leaves all others.

    A run is there once its folder's success mark is, which Spark writes last; what a run that broke
    off has written is never read, and the next run takes its place. One driver writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def numbers(self) -> list[int]:
        """The runs that are there, in order."""
        jvm, folder = self.spark._jvm, self.path
        at = jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
        whole = [n for n in names if n.startswith("run=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("run=")) for n in whole)

    def write(self, rows: DataFrame) -> int:
        """Writes rows (one for each key) as the next run and returns its number."""
        number = max(self.numbers(), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/run={number}")
        return number

    def last(self, asked: DataFrame | None = None) -> DataFrame:
        """The row of each key's newest run, with ``run``; of the keys asked for, if given, with nulls where there is none.

        Which run is a key's newest is told by keys alone; the rows are joined to that, once.
        """
        numbers = self.numbers()
        if not numbers:
            raise FileNotFoundError(f"no run at {self.path}")
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/run={n}" for n in numbers]).withColumn("run", F.col("run").cast("long"))
        if len(numbers) == 1:
            return rows if asked is None else asked.join(rows, [*self.keys], "left")
        newest = rows.groupBy(*self.keys).agg(F.max("run").alias("run"))
        if asked is None:
            return rows.join(newest, [*self.keys, "run"])
        return asked.join(newest, [*self.keys], "left").join(rows, [*self.keys, "run"], "left")


def sources(books: DataFrame, meta: DataFrame) -> DataFrame:
    """What pruning gets of each book asked for: book_id, answer, text and chapters.

    books: book_id, text. meta: book_id, extract_status, chapters (array of title, level,
    start_char, end_char, any of them null). answer: 'absent' without a text, 'unready' if the
    status isn't ok or there is no metadata, else 'ok', with the chapters' gaps filled in: no title,
    level 1, from the text's start, to its end.
    """
    known = meta.select("book_id", "extract_status", F.col("chapters").cast(CHAPTERS).alias("_c"))
    # A full join's rows count as dealt by nothing, and texts would be shuffled again by whoever asks for them by book.
    missing = known.join(books.select("book_id"), "book_id", "left_anti").withColumn("text", F.lit(None).cast("string"))
    both = books.select("book_id", "text").join(known, "book_id", "left").unionByName(missing)
    answer = F.when(F.col("text").isNull(), "absent").when(F.coalesce("extract_status", F.lit("")) != "ok", "unready").otherwise("ok")
    size = F.length("text").cast("long")
    filled = lambda c: F.struct(F.coalesce(c["title"], F.lit("")).alias("title"), F.coalesce(c["level"], F.lit(1)).alias("level"), F.coalesce(c["start_char"], F.lit(0)).cast("long").alias("start_char"), F.coalesce(c["end_char"], size).alias("end_char"))
    chapters = F.coalesce(F.transform("_c", filled).cast(CHAPTERS), F.array().cast(CHAPTERS))
    ready = F.col("answer") == "ok"
    return both.withColumn("answer", answer).select("book_id", "answer", F.when(ready, F.col("text")).alias("text"), F.when(ready, chapters).alias("chapters"))


def run_prune(store: Runs, asked: DataFrame, restores: DataFrame | None = None) -> int:
    """Prunes the books that are ok (:func:`sources`), gives back what restores name, and stores the results as a run.

    A result has book_id, pruned_text, regions, original_chars, removed_chars, kept_ratio and
    pruned_chapters, the chapters at their places after removal.
    """
    books = asked.where("answer = 'ok'")
    rows = prune.pruned(books.select("book_id", "text", "chapters"), F.col("chapters"), restores)
    moved = prune.moved(F.col("chapters"), F.col("regions"), F.col("original_chars"), F.col("removed_chars"))
    rows = rows.withColumn("pruned_chapters", moved.cast(CHAPTERS))
    return store.write(rows.select("book_id", "pruned_text", "regions", "original_chars", "removed_chars", "kept_ratio", "pruned_chapters"))


def last_results(store: Runs, asked: DataFrame) -> DataFrame:
    """The stored result of each book asked for (book_id), as a preview shows it, without chapters; ``answer`` is 'absent' if it was never pruned."""
    rows = store.last(asked.select("book_id").distinct()).drop("pruned_chapters")
    return rows.withColumn("answer", F.when(F.col("run").isNotNull(), "ok").otherwise("absent"))


def restore_pairs(given: DataFrame) -> DataFrame:
    """given (book_id, pairs: array<array<long>>) as restores (book_id, start, stop); lists that aren't pairs are passed over."""
    pairs = given.select("book_id", F.explode("pairs").alias("p")).where(F.size("p") == 2)
    return pairs.select("book_id", F.get("p", F.lit(0)).alias("start"), F.get("p", F.lit(1)).alias("stop"))


def as_json(results: DataFrame) -> DataFrame:
    """book_id and the result's numbers, regions and chapters as one JSON text."""
    regions = F.transform("regions", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("end"), r["reason"].alias("reason"), r["label"].alias("label")))
    return results.select("book_id", F.to_json(F.struct("original_chars", "removed_chars", "kept_ratio", regions.alias("regions"), "pruned_chapters")).alias("json"))
