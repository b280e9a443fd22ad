from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tomeloom.operators import distill, store

LINE = "a line that comes back"
TEXT = f"Chapter 1\n{LINE}\nx\n{LINE}\ny\n{LINE}\nChapter 2\nthe rest of it\n"


def asked(spark, ids):
    books = spark.createDataFrame([(i, TEXT + str(i)) for i in ids], "book_id long, text string")
    chapters = [("One", 1, 0, 80), (None, None, TEXT.index("Chapter 2"), None)]
    meta = spark.createDataFrame([(i, "ok", chapters) for i in ids], f"book_id long, extract_status string, chapters {store.CHAPTERS}")
    return store.sources(books, meta)


def test_runs_replace_their_own_books_only(spark, tmp_path):
    runs = store.Runs(spark, str(tmp_path / "prunes"), "book_id")
    assert runs.numbers() == []
    with pytest.raises(FileNotFoundError):
        runs.last()
    assert store.run_prune(runs, asked(spark, range(6))) == 1
    given = spark.createDataFrame([(2, [[0, 500], [3]]), (3, [[1, 2, 3]])], "book_id long, pairs array<array<long>>")
    assert store.run_prune(runs, asked(spark, [1, 2, 3]), store.restore_pairs(given)) == 2
    got = {r.book_id: r for r in store.last_results(runs, spark.range(8).withColumnRenamed("id", "book_id")).collect()}
    assert {i: (r.answer, r.run) for i, r in got.items()} == {0: ("ok", 1), 1: ("ok", 2), 2: ("ok", 2), 3: ("ok", 2), 4: ("ok", 1), 5: ("ok", 1), 6: ("absent", None), 7: ("absent", None)}
    assert got[2].pruned_text == TEXT + "2" and got[2].removed_chars == 0 and got[3].pruned_text == (TEXT + "3").replace(LINE, "") == got[3].pruned_text
    assert "pruned_chapters" not in got[0].asDict()
    rows = {r.book_id: json.loads(r.json) for r in store.as_json(runs.last()).collect()}
    assert [c["title"] for c in rows[0]["pruned_chapters"]] == [""] and rows[0]["pruned_chapters"][0]["level"] == 1  # the first loses more than half
    assert rows[0]["removed_chars"] == 3 * len(LINE) and [r["reason"] for r in rows[0]["regions"]] == ["duplicate"] * 3


def test_a_run_that_broke_off_is_never_read(spark, tmp_path):
    runs = store.Runs(spark, str(tmp_path / "prunes"), "book_id")
    runs.write(spark.createDataFrame([(1, "a"), (2, "b")], "book_id long, v string"))
    runs.write(spark.createDataFrame([(2, "half")], "book_id long, v string"))
    os.remove(tmp_path / "prunes" / "run=2" / "_SUCCESS")  # as if it had broken off before the commit
    assert sorted((r.book_id, r.v, r.run) for r in runs.last().collect()) == [(1, "a", 1), (2, "b", 1)]
    assert runs.write(spark.createDataFrame([(1, "c")], "book_id long, v string")) == 2
    assert sorted((r.book_id, r.v, r.run) for r in runs.last().collect()) == [(1, "c", 2), (2, "b", 1)]


def test_sources_are_guarded(spark):
    books = spark.createDataFrame([(1, "abc"), (2, "de"), (3, "")], "book_id long, text string")
    meta = spark.createDataFrame([(1, "ok", [("T", 2, 1, 2), (None, None, None, None)]), (2, "pending", []), (3, "ok", None), (4, "ok", [])], f"book_id long, extract_status string, chapters {store.CHAPTERS}")
    got = {r.book_id: r for r in store.sources(books, meta.where("book_id <> 2").unionByName(meta.where("book_id = 2"))).collect()}
    assert {i: r.answer for i, r in got.items()} == {1: "ok", 2: "unready", 3: "ok", 4: "absent"}
    assert [tuple(c) for c in got[1].chapters] == [("T", 2, 1, 2), ("", 1, 0, 3)] and got[3].chapters == [] and got[2].text is None
    assert {r.answer for r in store.sources(books, meta.where("false")).collect()} == {"unready"}


def test_a_unit_stops_at_its_first_failure(spark, tmp_path):
    log = tmp_path / "calls"

    def model(title, text, target):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text.endswith("bad"):
            raise ValueError("no answer")
        return "short" if text.endswith("short") else "x" * target

    rows = []
    for book in range(3):
        for unit in range(5):
            for chunk in range(7):
                end = "bad" if unit == 1 and chunk == 2 else "short" if unit == 3 and chunk == 0 else "fine"
                rows.append((book, unit, chunk, f"u{unit}_{chunk}", "k", "t", 20, f"{book} {unit} {chunk} {end}"))
    schema = "book_id long, unit_ix int, chunk_ix int, unit_id string, cache_key string, title string, chunk_target int, chunk_text string"
    chunks = spark.createDataFrame(rows, schema).repartition(5, F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a unit's chunks lie in several batches
    try:
        out = distill.condense(chunks, model).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls = log.read_text().splitlines()
    expected = [f"{b} {u} {c}" for b in range(3) for u in range(5) for c in range(7) if not (u == 1 and c > 2 or u == 3 and c > 0)]
    assert sorted({x.rsplit(" ", 1)[0] for x in calls}) == sorted(expected)
    assert sum(x.endswith("bad") for x in calls) == 3 and sum(x.endswith("short") for x in calls) == 3 * distill.ATTEMPTS
    assert len(out) == len(expected)
    spoiled = {(r.book_id, r.unit_ix, r.chunk_ix): (r.attempts, r.error) for r in out if r.error}
    assert spoiled == {(b, u, c): (n, e) for b in range(3) for u, c, n, e in ((1, 2, 1, "no answer"), (3, 0, 3, "short"))}
    merged = {r.book_id: r for r in distill.merged(spark.createDataFrame(out)).collect()}
    assert all(merged[b].n_units == 5 and merged[b].n_errors == 2 and merged[b].output.count("x" * 20) == 3 * 7 + 2 for b in range(3))
