"""Book folders as a data source: ``spark.read.format("books").load(folder)`` once :func:`register` has been called.

Files are dealt into partitions of about equal bytes. What reads a file is chosen by its extension
in READERS, to which :func:`reads` adds more. A file that can't be read is a row with an error. The
folder must be one that the driver and all executors see as files (a mounted share); books in other
stores come through ``binaryFile`` and :func:`tables.file_books`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import _epub_texts, epub_parts, sniffed

#: title, author, text parts (HTML ones for EPUB) of a file's bytes; any exception is the file's error.
Reader = Callable[[bytes, str], tuple[str, str, list[str]]]
READERS: dict[str, Reader] = {}


def reads(*extensions: str) -> Callable[[Reader], Reader]:
    """Makes a function the reader of files of these extensions, for sources that are registered afterwards."""

    def add(reader: Reader) -> Reader:
        for e in extensions:
            READERS[e.lower()] = reader
        return reader

    return add


def _text(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = sniffed(raw)
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


@reads("txt")
def plain(raw: bytes, stem: str) -> tuple[str, str, list[str]]:
    text = _text(raw)
    return text.lstrip().split("\n", 1)[0].strip() or stem, "", [text]


@reads("md")
def markdown(raw: bytes, stem: str) -> tuple[str, str, list[str]]:
    text = _text(raw)
    front = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*\n", text, re.S)
    keys = dict(re.findall(r"(?m)^\s*(title|author)\s*:\s*(.+?)\s*$", front[1])) if front else {}
    heading = re.search(r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$", text)
    bare = lambda k: keys.get(k, "").strip("\"'")
    return bare("title") or (heading[1] if heading else stem), bare("author"), [text]


@reads("epub")
def epub(raw: bytes, stem: str) -> tuple[str, str, list[str]]:
    title, author, parts = epub_parts(raw)
    return title or stem, author, parts


class Files(InputPartition):
    def __init__(self, paths: list[str], readers: dict[str, Reader]):
        super().__init__(0)
        self.paths, self.readers = paths, readers


class BookReader(DataSourceReader):
    def __init__(self, folder: str, bytes_each: int, readers: dict[str, Reader]):
        self.folder, self.bytes_each, self.readers = folder.removeprefix("file:"), bytes_each, readers

    def partitions(self) -> list[Files]:
        found = [(os.path.join(at, name), os.path.getsize(os.path.join(at, name))) for at, _, names in os.walk(self.folder) for name in names if not name.startswith((".", "_"))]
        out: list[list[str]] = [[]]
        size = 0
        for path, n in sorted(found):
            if out[-1] and size + n > self.bytes_each:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(paths, self.readers) for paths in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            stem, _, ext = os.path.basename(path).rpartition(".")
            ext, stem = ext.lower() if stem else "", stem or os.path.basename(path)
            try:
                if ext not in partition.readers:
                    raise ValueError(f"no reader for .{ext}")
                with open(path, "rb") as f:
                    title, author, parts = partition.readers[ext](f.read(), stem)
                yield path, title, author, ext, parts, "" if any(p.strip() for p in parts) else "empty"
            except Exception as bad:  # readers are foreign code: a file's failure is its row's
                yield path, stem, "", ext, [], f"{type(bad).__name__}: {bad}"


class BookSource(DataSource):
    """Options: path (the folder), bytesEach (bytes of a partition, 64 MB unless given)."""

    readers = READERS

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return "path string, title string, author string, source_format string, parts array<string>, error string"

    def reader(self, schema) -> BookReader:
        return BookReader(self.options["path"], int(self.options.get("bytesEach", 64 << 20)), self.readers)


def register(spark: SparkSession) -> None:
    """Registers the source with the readers that there are now: Spark plans and reads in other processes."""

    class Books(BookSource):
        readers = dict(READERS)

    spark.dataSource.register(Books)


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, author, source_format, text, error and extract_status of a folder's files."""
    register(spark)
    rows = spark.read.format("books").load(folder)
    text = F.when(F.col("source_format") == "epub", F.array_join(_epub_texts(F.col("parts")), "\n\n")).otherwise(F.array_join("parts", "\n\n"))
    rows = rows.withColumn("text", text).drop("parts")
    return rows.withColumn("extract_status", F.when(F.col("error") == "", "ok").otherwise("error"))
