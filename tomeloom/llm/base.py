"""Helpers that the operators share: reading tables, cutting lineage, vectorised tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder as shared_folder
from ..sources.tables import spread as spread

#: Bytes of text that one vectorised step takes at a time (a longer text is taken alone).
CHUNK_BYTES = 2 << 20

#: ASCII white space: 0x20 and 0x09 to 0x0D.
WHITE = frozenset([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte but letters and digits.
NOT_ALNUM = frozenset(b for b in range(0x80) if not chr(b).isalnum())

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns beyond these never enter the plan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors don't undo it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _MUL
    return x ^ (x >> np.uint64(32))


class Tokens:
    """Words of a run of texts: byte spans, index of the text, 64-bit hashes."""

    __slots__ = ("start", "end", "doc", "hash", "docs")

    def __init__(self, start, end, doc, hashes, docs):
        self.start, self.end, self.doc, self.hash, self.docs = start, end, doc, hashes, docs


class Tokenizer:
    """Splits UTF-8 text at the separator bytes after lower-casing A-Z, without a Python loop over words.

    A word's hash is a polynomial in its bytes modulo 2**64, taken as the difference of two
    prefix sums and then finalised, so that it doesn't depend on the word's position.
    """

    def __init__(self, separators: frozenset[int]):
        table = np.arange(256, dtype=np.uint64) + np.uint64(1)
        for b in range(ord("A"), ord("Z") + 1):
            table[b] = b + 33
        self.value = mix(table, 7)
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[sorted(separators)] = False
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", _INV)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word; data: UTF-8 bytes of all texts; offsets: where each begins, then the end (relative to data)."""
        n, docs = len(data), len(offsets) - 1
        word = np.zeros(n + 1, dtype=bool)
        word[:n] = self.is_word[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offsets[:-1][offsets[:-1] < n]
        begin[inner] = word[inner]
        start = np.flatnonzero(begin)
        if not len(start):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        stop = np.zeros(n + 1, dtype=bool)
        stop[1:] = word[:-1] & ~word[1:]
        stop[inner] |= word[inner - 1] & (inner > 0)
        end = np.flatnonzero(stop)
        return start, end, np.repeat(np.arange(docs), np.diff(np.searchsorted(start, offsets)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        """The words of the texts, as :meth:`spans` finds them, with their hashes."""
        docs = len(offsets) - 1
        start, end, doc = self.spans(data, offsets)
        return Tokens(start, end, doc, self.hashed(data, start, end)[0], docs)

    def hashed(self, data: np.ndarray, start: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """The hashes of the bytes from each start to each of its ends."""
        n = len(data)
        if not len(start):
            return [start.astype(np.uint64) for _ in ends]
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        return [mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)) for end in ends]


def text_runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, dtype=np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
