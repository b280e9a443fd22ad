"""The job ledger as relations: every statement takes tables and returns the table that follows.

Nothing is updated in place. A state is the latest row of a key, and one driver writes.
tasks: task_id, book_id, status, stage, queue_order, cancel_requested, delete_requested,
created_at. units: task_id, unit_id, status, cache_key, output, updated_at. cache: cache_key,
book_id, output, hit_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queue places that one window numbers by itself.
RUN = 100_000


def numbered(rows: DataFrame, run: Column, *order: str | Column) -> DataFrame:
    """rows with ``_n``, their places from 1 by ``run``, then ``order``.

    Each run is numbered in a window of its own; only the counts of the runs, a row each, meet in
    one place. ``run`` must not fall as the order rises.
    """
    named = rows.withColumn("_run", run)
    counts = named.groupBy("_run").agg(F.count("*").alias("_count"))
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("_run").alias("_r"), F.coalesce(F.sum("_count").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(*order))
    return named.withColumn("_in", inside).join(first, F.col("_run").eqNullSafe(F.col("_r"))).withColumn("_n", F.col("_before") + F.col("_in")).drop("_run", "_r", "_in", "_before")


def next_orders(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """new (task_id, created_at) that aren't known yet, with queue orders after the largest; numbered day by day."""
    top = tasks.agg(F.coalesce(F.max("queue_order"), F.lit(-1)).alias("_top"))
    fresh = numbered(new.join(tasks, "task_id", "left_anti"), F.to_date("created_at"), "created_at", "task_id")
    return fresh.join(F.broadcast(top)).withColumn("queue_order", (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top")  # one row


def queued(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("queue_order", "created_at")


def placed(tasks: DataFrame) -> DataFrame:
    """tasks with ``place`` from 1, their order in the whole queue: by queue order, then age."""
    return numbered(tasks, F.floor(F.col("queue_order") / RUN), "queue_order", "created_at", "task_id").withColumnRenamed("_n", "place")


def looked_up(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """The tasks of asked (task_id, distinct) with ``found``, false for those that aren't there."""
    return asked.select("task_id").join(tasks.withColumn("_there", F.lit(True)), "task_id", "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def eligible(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending' and not cancel_requested and not delete_requested")


def claimed(tasks: DataFrame, task_id) -> DataFrame:
    """The task moves to running if it is still eligible; the caller compares before and after."""
    return claims(tasks, tasks.where(F.col("task_id") == F.lit(task_id)))


def claims(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """The tasks of asked (task_id) that are still eligible move to running; who claims compares before and after."""
    rows = tasks.join(asked.select("task_id", F.lit(True).alias("_asked")).distinct(), "task_id", "left")
    may = F.coalesce("_asked", F.lit(False)) & (F.col("status") == "pending") & ~F.col("cancel_requested") & ~F.col("delete_requested")
    return rows.withColumn("stage", F.when(may, "prune").otherwise(F.col("stage"))).withColumn("status", F.when(may, "running").otherwise(F.col("status"))).drop("_asked")


def cancelled(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (task_id): pending tasks are cancelled, running ones flagged."""
    rows = tasks.join(asked.select("task_id", F.lit(True).alias("_asked")).distinct(), "task_id", "left")
    hit = F.coalesce("_asked", F.lit(False))
    return (
        rows.withColumn("cancel_requested", F.col("cancel_requested") | (hit & (F.col("status") == "running")))
        .withColumn("stage", F.when(hit & (F.col("status") == "pending"), "cancelled").otherwise(F.col("stage")))
        .withColumn("status", F.when(hit & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))
        .drop("_asked")
    )


def recovered(tasks: DataFrame) -> DataFrame:
    """After a restart: flagged deletions go, running tasks that were cancelled are cancelled, other running ones wait again."""
    running = F.col("status") == "running"
    return tasks.where("not delete_requested").withColumn("stage", F.when(running & F.col("cancel_requested"), "cancelled").when(running, "queued").otherwise(F.col("stage"))).withColumn(
        "status", F.when(running & F.col("cancel_requested"), "cancelled").when(running, "pending").otherwise(F.col("status"))
    )


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str], at: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The latest row of each key; of equal times the change wins."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = [F.col(at).desc(), F.col("_new").desc()] + ([F.col(tie).desc()] if tie else [])
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n", "_new")


def reset_failed(units: DataFrame) -> DataFrame:
    failed = F.col("status") == "error"
    return units.withColumn("output", F.when(~failed, F.col("output"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def put_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """new outputs replace old ones; an owner stays unless the new one is named; hits stay."""
    n = new.select("cache_key", F.col("book_id").alias("_book"), F.col("output").alias("_output"))
    both = cache.join(n, "cache_key", "full")
    return both.select("cache_key", F.coalesce(F.when(F.col("_book") != "", F.col("_book")), F.col("book_id"), F.lit("")).alias("book_id"), F.coalesce("_output", "output").alias("output"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


def counted_hits(cache: DataFrame, asked: DataFrame) -> DataFrame:
    hits = asked.groupBy("cache_key").agg(F.count("*").alias("_n"))
    return cache.join(hits, "cache_key", "left").withColumn("hit_count", (F.col("hit_count") + F.coalesce("_n", F.lit(0))).cast("long")).drop("_n")


def backfilled(cache: DataFrame, units: DataFrame, tasks: DataFrame) -> DataFrame:
    """Owners for cache rows without one: the book of the first task that used the key."""
    used = units.join(tasks.select("task_id", F.col("book_id").alias("_book")), "task_id").groupBy("cache_key").agg(F.min_by("_book", F.struct("task_id", "unit_id")).alias("_book"))
    return cache.join(used, "cache_key", "left").withColumn("book_id", F.when(F.coalesce("book_id", F.lit("")) == "", F.coalesce("_book", F.lit(""))).otherwise(F.col("book_id"))).drop("_book")


def delete_requested(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (task_id) with answer: absent, deleting (it runs, and gets both flags) or deleted."""
    known = asked.select("task_id").distinct().join(tasks.select("task_id", "status"), "task_id", "left")
    return known.select("task_id", F.when(F.col("status").isNull(), "absent").when(F.col("status") == "running", "deleting").otherwise("deleted").alias("answer"))


def deleted(tasks: DataFrame, units: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, units) without the tasks of gone (task_id); units follow their task."""
    left = tasks.join(gone, "task_id", "left_anti")
    return left, units.join(left.select("task_id"), "task_id", "left_semi")


def purged(tasks: DataFrame, units: DataFrame, cache: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, units, cache) without the books (book_id): cache rows that the book owns or its tasks' units used go too."""
    of_book = tasks.join(books, "book_id", "left_semi").select("task_id")
    used = units.join(of_book, "task_id", "left_semi").select("cache_key")
    owned = cache.join(books, "book_id", "left_semi").select("cache_key")
    left_tasks, left_units = deleted(tasks, units, of_book)
    return left_tasks, left_units, cache.join(used.union(owned).distinct(), "cache_key", "left_anti")


def deletion_preview(tasks: DataFrame) -> DataFrame:
    """book_id, n_tasks, n_active and the ids of active tasks in order."""
    active = F.col("status").isin("pending", "running")
    return tasks.groupBy("book_id").agg(F.count("*").alias("n_tasks"), F.count_if(active).alias("n_active"), F.array_join(F.array_sort(F.collect_list(F.when(active, F.col("task_id")))), ",").alias("active_ids"))


def moved_before(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """tasks renumbered densely with one of them put before another.

    asked: one row, moved and before. Nothing moves if they are one task or if either isn't there.
    """
    ids = tasks.select("task_id", "queue_order")
    at = asked.join(ids.withColumnRenamed("task_id", "moved"), "moved").drop("queue_order").join(ids.select(F.col("task_id").alias("before"), F.col("queue_order").alias("_at")), "before").where("moved <> before")
    key = F.when(F.col("task_id") == F.col("moved"), F.col("_at") - 0.5).otherwise(F.col("queue_order").cast("double"))
    placed = tasks.join(F.broadcast(at), how="left").withColumn("_key", key)  # at most one row
    return numbered(placed, F.floor(F.col("_key") / RUN), "_key", "created_at", "task_id").withColumn("queue_order", F.col("_n") - 1).drop("_n", "_key", "moved", "before", "_at")


def updated(tasks: DataFrame, changes: DataFrame, allowed: tuple[str, ...] = ("status", "stage", "queue_order", "cancel_requested", "delete_requested")) -> DataFrame:
    """tasks with the columns that changes (task_id and some of the allowed ones) name; a null changes nothing.

    An unknown column is an error here; an unknown task gets a row in :func:`missing`.
    """
    named = [c for c in changes.columns if c != "task_id"]
    if unknown := [c for c in named if c not in allowed]:
        raise ValueError(f"unsupported task columns: {unknown}")
    new = changes.select("task_id", *[F.col(c).alias(f"_{c}") for c in named])
    return tasks.join(new, "task_id", "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in named else F.col(c) for c in tasks.columns])


def missing(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that name no task."""
    return changes.join(tasks, "task_id", "left_anti")


def units_in_order(units: DataFrame) -> DataFrame:
    """units with ``place``, their order within a task."""
    return units.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("unit_id")).cast("long"))


def tasks_of_books(tasks: DataFrame) -> DataFrame:
    """tasks with ``place``, their order within a book: by queue, then age."""
    return tasks.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("queue_order", "created_at", "task_id")).cast("long"))


def prepared_deletions(tasks: DataFrame, deletions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (book_id) with state and blocking: the state there is wins; else active tasks block, named in queue order; else 'preparing'."""
    active = tasks.where("status in ('pending', 'running')").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("queue_order", "created_at", "task_id"))).alias("_active"))
    known = asked.select("book_id").distinct().join(deletions.select("book_id", F.col("state").alias("_state")), "book_id", "left").join(active, "book_id", "left")
    names = F.array_join(F.transform("_active", lambda t: t["task_id"].cast("string")), ",")
    blocked = F.col("_state").isNull() & F.col("_active").isNotNull()
    return known.select("book_id", F.coalesce("_state", F.when(blocked, "blocked").otherwise("preparing")).alias("state"), F.when(blocked, names).otherwise("").alias("blocking"))


def decoded_row(raw: Column, fields: str) -> Column:
    """A JSON column as a struct of ``fields`` (DDL); empty, null or damaged JSON gives nulls inside, not a null."""
    return F.from_json(F.coalesce(F.when(F.trim(raw) != "", raw), F.lit("{}")), fields, {"mode": "PERMISSIVE"})


def is_resource_id(value: Column) -> Column:
    """A letter or digit, then at most 127 letters, digits, underscores and hyphens."""
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z"), F.lit(False))


def managed_files(files: DataFrame, books: DataFrame) -> DataFrame:
    """files (name, folder) of exactly the books (book_id): in 'books' <id>.txt, <id>.meta.json and <id>_*, in 'intermediate' <id>.*; hidden ones are nobody's.

    An id may hold underscores, so every prefix of a name that ends before one is a candidate, and
    an equality join tells which of them are books.
    """
    cuts = F.regexp_extract_all("name", F.lit("_"), F.lit(0))
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(cuts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    in_books = F.array_union(F.when(F.size(cuts) > 0, prefixes).otherwise(F.array().cast("array<string>")), F.array(F.regexp_extract("name", r"^(.*?)\.(?:txt|meta\.json)$", 1)))
    owners = F.when(F.col("folder") == "books", in_books).otherwise(F.array(F.regexp_extract("name", r"^([^.]*)\.", 1)))
    named = files.where("name not like '.%'").withColumn("book_id", F.explode(owners)).where(is_resource_id(F.col("book_id")))
    return named.join(books.select("book_id").distinct(), "book_id", "left_semi").select("book_id", "folder", "name").distinct()


def fingerprint(known: Column, content: Column) -> Column:
    """The known fingerprint if it is 64 hex digits, else SHA-256 of the content."""
    tidy = F.lower(F.trim(known))
    return F.when(tidy.rlike(r"\A[0-9a-f]{64}\z"), tidy).otherwise(F.sha2(content, 256))


def shown_status(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "quality_failed", "error").otherwise(F.col("status")))


def advanced(deletions: DataFrame, state: str, asked: DataFrame) -> DataFrame:
    """deletions (book_id, state, ...) of asked books move on, completed ones never."""
    hit = deletions.join(asked.select("book_id", F.lit(True).alias("_asked")).distinct(), "book_id", "left")
    return hit.withColumn("state", F.when(F.col("_asked") & (F.col("state") != "completed"), state).otherwise(F.col("state"))).drop("_asked")


def incomplete(deletions: DataFrame) -> DataFrame:
    return deletions.where("state <> 'completed'").orderBy("created_at")
