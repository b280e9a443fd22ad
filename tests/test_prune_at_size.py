"""Pruning against a plain reading of its rules, and on texts of tens of thousands of regions."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tomeloom.operators import prune

BACK = re.compile(r"^(references|bibliography|index|notes)$", re.I)
STRUCTURE = re.compile(r"^(Chapter\s+\d+|Preface|Afterword)\b")
SCHEMA = "book_id long, start long, stop long, seq long, reason string, label string"


def back_matter(text, chapters):
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line.strip().lstrip("#").strip()))
        at += len(line) + 1
    first = next((p for p, h in lines if re.match(r"Chapter\s+\d+\b", h)), None)
    first = min((s for s in chapters if s > 0), default=first) if chapters else first
    out = []
    for p, h in lines:
        if BACK.match(h) and (first is None or p >= first):
            after = [s for s in chapters if s > p + len(h)]
            bounds = [q for q, x in lines if q >= p + len(h) and STRUCTURE.match(x)]
            out.append((p, min(after) if after else bounds[0] if bounds else len(text), h))
    return out


def plain_merge(rows):
    out = []
    for _, start, stop, _, reason, label in sorted(rows, key=lambda r: r[1:4]):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1][1] = stop
                if len(label) > len(out[-1][3]):
                    out[-1][3] = label
        else:
            out.append([start, stop, reason, label])
    return [tuple(r) for r in out]


def test_back_matter_equals_a_plain_reading(spark):
    rng = random.Random(5)
    words = ["References", "## Notes", "  index ", "Chapter 1", "# Chapter 22 x", "Preface", "Afterwords", "body text", "", "References of", "#  Bibliography\r"]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    books = spark.createDataFrame(list(enumerate(texts)), "book_id long, text string")
    chapters = [(i, k, "t", 1, s) for i, t in enumerate(texts) for k, s in enumerate(sorted({rng.randint(0, len(t)) for _ in range(rng.randint(0, 3))}))]
    starts = spark.createDataFrame(chapters, "book_id long, chapter_ix int, title string, level int, start_char long")
    for given in (False, True):
        got = prune.backmatter_regions(books, starts if given else None).collect()
        expected = [(i, *r) for i, t in enumerate(texts) for r in back_matter(t, [c[4] for c in chapters if c[0] == i] if given else [])]
        assert sorted((r.book_id, r.start, r.stop, r.label) for r in got) == sorted(expected)


def test_merge_equals_a_plain_fold(spark):
    rng = random.Random(6)
    rows = []
    for book in range(150):
        for k in range(rng.randint(0, 12)):
            start = rng.randint(0, 40)
            rows.append((book, start, start + rng.randint(1, 12), k, rng.choice("abc"), "x" * rng.randint(0, 4) + rng.choice("pq")))
    got = prune.merged(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    expected = [(b, *r) for b in range(150) for r in plain_merge([x for x in rows if x[0] == b])]
    assert sorted((r.book_id, r.start, r.stop, r.reason, r.label) for r in got) == sorted(expected)


@pytest.mark.parametrize("size", [5, 7, 4096])
def test_removal_equals_slices(spark, monkeypatch, size):
    monkeypatch.setattr(prune, "PIECE", size)
    rng = random.Random(7)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("aé漢😀\n ") for _ in range(rng.randint(0, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 5)) // 2 * 2))
        rows.append((i, text, [(a, b, 0, "r", "") for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    df = spark.createDataFrame(rows, f"id long, text string, regions {prune.REGION}")
    for r in df.select("*", prune.applied(F.col("text"), F.col("regions")).alias("left")).collect():
        plain, at = "", 0
        for x in r.regions:
            plain, at = plain + r.text[at : x.start], x.stop
        assert r.left == plain + r.text[at:]


def test_chapters_move_inside_a_row_as_they_do_by_join(spark):
    rng = random.Random(8)
    rows, chapters = [], []
    for i in range(100):
        size = rng.randint(1, 80)
        cuts = sorted(rng.sample(range(size + 1), min(size + 1, 2 * rng.randint(0, 4)) // 2 * 2))
        mine = [("t", 1, a := rng.randint(0, size), a + rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        rows.append((i, mine, [(a, b, 0, "r", "") for a, b in zip(cuts[::2], cuts[1::2], strict=True)], size, sum(b - a for a, b in zip(cuts[::2], cuts[1::2], strict=True))))
        chapters += [(i, k, *c) for k, c in enumerate(mine)]
    found = spark.createDataFrame(rows, f"book_id long, chapters array<struct<title:string,level:int,start_char:long,end_char:long>>, regions {prune.REGION}, original_chars long, removed_chars long")
    joined = prune.remapped(spark.createDataFrame(chapters, "book_id long, chapter_ix int, title string, level int, start_char long, end_char long"), found)
    inside = found.select("book_id", F.explode(prune.moved(F.col("chapters"), F.col("regions"), F.col("original_chars"), F.col("removed_chars"))).alias("c"))
    assert sorted((r.book_id, r.c.start_char, r.c.end_char) for r in inside.collect()) == sorted((r.book_id, r.start_char, r.end_char) for r in joined.collect())


def test_tens_of_thousands_of_regions_in_one_text(spark):
    line = "a line that comes back"
    many = "".join(f"{line}\nx{i}\n" for i in range(40_000))
    headings = "Chapter 1\n" + "".join(f"References\nsome {i}\nChapter {i}\n" for i in range(10_000))
    books = spark.createDataFrame([(0, many), (1, headings), (2, "short")], "book_id long, text string").cache()
    books.count()
    began = time.time()
    got = {r.book_id: r for r in prune.pruned(books).select("book_id", "pruned_text", "removed_chars", F.size("regions").alias("n")).collect()}
    took = time.time() - began
    assert got[0].n == 40_000 and got[0].pruned_text == many.replace(line, "")
    assert got[1].n == 10_000 and got[1].pruned_text == "Chapter 1\n" + "".join(f"Chapter {i}\n" for i in range(10_000))
    assert got[2].pruned_text == "short" and took < 30, took
    print(took)
