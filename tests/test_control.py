from __future__ import annotations

import time
import zipfile

from pyspark.sql import functions as F

from tomeloom.operators import distill, store
from tomeloom.sources import datasource
from tomeloom.streaming import control

SCHEMA = "book_id long, unit_ix int, chunk_ix int, unit_id string, cache_key string, title string, chunk_target int, chunk_text string"


def chunks(spark):
    rows = [(b, u, c, f"u{u}_{c}", "k", "t", 8, f"{b} {u} {c}") for b in range(4) for u in range(5) for c in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_observed_counts_equal_the_result(spark):
    def model(title, text, target):
        if text.startswith("1 2"):
            raise ValueError("no")
        return "short" if text.startswith("2 3") else "x" * target

    rows, watched = control.observed(distill.condense(chunks(spark), model))
    got = rows.collect()
    assert watched.get == {"chunks": len(got), "failed": sum(r.error != "" for r in got), "calls": sum(r.attempts for r in got), "chars": sum(len(r.output) for r in got)}
    assert watched.get["failed"] == 2 and watched.get["chunks"] == 60 - 2 * 2


def test_stopped_work_keeps_finished_batches_and_goes_on(spark, tmp_path):
    log, done = tmp_path / "calls", store.Runs(spark, str(tmp_path / "done"), "book_id", "unit_ix", "chunk_ix")

    def model(title, text, target):
        with open(log, "a") as f:
            f.write(text + "\n")
        return "x" * target

    told = []
    work = lambda stop: control.work_in_batches(chunks(spark), lambda c: distill.condense(c, model), done, stop, 4, told=lambda n, m: told.append((n, m)))
    assert not work(lambda: len(told) >= 2)
    assert done.numbers() == [1, 2]
    first = set(log.read_text().splitlines())
    assert done.last().count() == len(first) == sum(m["chunks"] for _, m in told)
    assert work(lambda: False) and done.last().count() == 60
    calls = log.read_text().splitlines()
    assert len(calls) == len(set(calls)) == 60 and work(lambda: False)  # nothing is asked twice


def test_a_running_batch_is_cancelled(spark, tmp_path):
    done = store.Runs(spark, str(tmp_path / "done"), "book_id", "unit_ix", "chunk_ix")
    began = tmp_path / "began"

    def slow(title, text, target):
        if not text.startswith("0"):
            began.touch()
            time.sleep(1.5)
        return "x" * target

    started = time.time()
    assert not control.work_in_batches(chunks(spark), lambda c: distill.condense(c, slow), done, began.exists, 1, poll=0.1)
    assert done.numbers() == [] and time.time() - started < 30
    assert control.work_in_batches(chunks(spark), lambda c: distill.condense(c, lambda *x: "x" * x[2]), done, lambda: False, 1) and done.last().count() == 60


def write_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Fixture</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<h1>One</h1><p>Text &amp; more</p>")


def test_folders_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "books"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("A first line\r\nand more", encoding="utf-8")
    (folder / "cjk.TXT").write_bytes("第一章 起点\n正文甲。".encode("gb18030"))
    (folder / "sub" / "b.md").write_text("---\ntitle: 'Named'\nauthor: B\n---\n# Heading\ntext", encoding="utf-8")
    (folder / "c.md").write_text("## Only a heading\nx", encoding="utf-8")
    write_epub(folder / "d.epub")
    (folder / "bad.epub").write_bytes(b"no archive")
    (folder / "x.pdf").write_bytes(b"%PDF")
    (folder / "empty.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r for r in datasource.read_books(spark, str(folder)).collect()}
    assert {n: (r.title, r.author, r.source_format) for n, r in got.items() if r.extract_status == "ok"} == {
        "a.txt": ("A first line", "", "txt"), "cjk.TXT": ("第一章 起点", "", "txt"), "b.md": ("Named", "B", "md"), "c.md": ("Only a heading", "", "md"), "d.epub": ("Fixture", "A", "epub")}
    assert got["d.epub"].text == "One\nText & more" and got["a.txt"].text == "A first line\nand more"
    assert {n: r.error.split(":")[0] for n, r in got.items() if r.extract_status == "error"} == {"bad.epub": "BadZipFile", "x.pdf": "ValueError", "empty.txt": "empty"}
    parts = spark.read.format("books").option("bytesEach", 10).load(str(folder))
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 4

    @datasource.reads("log")
    def numbered(raw, stem):
        return stem, "", [f"{len(raw)} bytes"]

    (folder / "y.log").write_bytes(b"12345")
    assert datasource.read_books(spark, str(folder)).where("source_format = 'log'").first().text == "5 bytes"
    datasource.READERS.pop("log")
