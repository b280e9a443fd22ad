"""What is worked out inside the rows of texts, against the plain ways, and that no text is shuffled for it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators import distill, prune, store, structure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_books(spark, n=300):
    rng = random.Random(11)
    parts = ["Chapter 1", "Chapter\t22 x", "CHAPTER 3y", "  Chapter 4", "\x85第 3 章 z", "第三章́", "Chapter 5́", "Chapter", "7", "\r", " ", "# Chapter 8", "\U0001f600 text", "References", "Notes", "Preface", "ISBN 1", "---", "a repeated line of text", ""]
    texts = ["".join(rng.choice(parts) + rng.choice(["\n", "\n", "\n", "\n\n", "\r\n", " "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(["", "\n", "Chapter 1", *texts])), "book_id long, text string")


def test_chapters_in_the_row_equal_those_of_lines_without_a_shuffle(spark):
    books = odd_books(spark)
    rows = structure.plain_chapters(books)
    by_lines = structure.plain_chapters(books, structure.line_spans(books))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(rows) == key(by_lines) and rows.count() > 300
    assert rows.schema.simpleString() == by_lines.schema.simpleString()
    assert "Exchange" in plan(by_lines) and "Exchange" not in plan(rows)


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1, 2000)),)], "x array<int>")
    for r in df.select("x", T.running(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))]


def test_chapters_in_the_row_prune_like_chapters_of_their_own_and_texts_are_read_once(spark, tmp_path):
    odd_books(spark).write.parquet(str(tmp_path / "books"))
    books = spark.read.parquet(str(tmp_path / "books"))
    held = books.withColumn("chapters", structure.chapters_of(F.col("text")))
    columns = ["book_id", "pruned_text", "regions", "removed_chars"]
    key = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    found = prune.regions(held, F.col("chapters"))
    assert plan(found).count("FileScan") == 1  # one listing of what the rules look at, chapters or not
    assert key(prune.pruned(held, F.col("chapters"))) == key(prune.pruned(books, structure.plain_chapters(books)))


def test_inputs_take_what_is_left_of_the_chapters(spark):
    kind = "array<struct<title:string,level:int,start_char:long,end_char:long>>"
    books = spark.createDataFrame([(1, "abcdef", [("a", 1, 0, 6)]), (2, "abcdef", [("b", 1, 0, 6)]), (3, "abc", []), (4, "abcd", [("d", 1, 1, 4)])], f"book_id long, text string, chapters {kind}")
    pruned = spark.createDataFrame([(1, "abc", [("a", 1, 0, 3)]), (2, "ab", []), (3, "", [])], f"book_id long, pruned_text string, pruned_chapters {kind}")
    got = sorted((r.book_id, r.text, [tuple(c) for c in r.chapters]) for r in distill.inputs(books, pruned).collect())
    assert got == [(1, "abc", [("a", 1, 0, 3)]), (2, "ab", [("b", 1, 0, 6)]), (3, "", []), (4, "abcd", [("d", 1, 1, 4)])]


def test_prune_sources_stay_dealt_by_book(spark):
    books = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "book_id long, text string")
    meta = spark.createDataFrame([(1, "ok", []), (2, "error", []), (3, "ok", []), (4, "ok", []), (None, "ok", [])], f"book_id long, extract_status string, chapters {store.CHAPTERS}")
    out = store.sources(books, meta)
    assert sorted((r.book_id or 0, r.answer, r.text) for r in out.collect()) == [(0, "absent", None), (0, "unready", None), (1, "ok", "a"), (2, "unready", None), (3, "absent", None), (4, "absent", None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = out.where("answer = 'ok'").groupBy("book_id").agg(F.max("text"))
        assert plan(asked).count("Exchange hashpartitioning") == 2  # books and metadata, and no more for what follows by book
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_heads_that_hold_no_mark_are_passed_over_and_no_others(spark):
    heads = ["CONTENT\u017f\n", "## tABLE OF contents\n", "\u76ee \u5f55\n", "x\n\nA \u00b7\u00b7 1\nB .. 2\nC  .3\nD \u3000 \u0664\n", "a CIP b\n", "iSbN\n", "\u5b9a\u4ef7\uff1a9\n", "\u76ee\n\u5f55\n", "A .. 1\nB .. 2\nC .. 3\n", "\u5b9a\u4ef7 9\n", "\u5370\u5237"]
    books = spark.createDataFrame([(i, f"{h}\nbody") for i, h in enumerate(heads)], "book_id long, text string")
    got = sorted((r.book_id, r.reason) for r in prune.head_regions(books).collect())
    assert got == [(0, "toc"), (1, "toc"), (2, "toc"), (3, "toc"), (4, "copyright"), (5, "copyright"), (6, "copyright"), (10, "copyright")]
