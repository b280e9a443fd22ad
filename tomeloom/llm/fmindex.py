"""Benchmark decontamination with an FM-index for each shard of the training text.

Texts are cut into words; every shard (a bounded run of texts inside one task) becomes a
sequence of symbols, suffix-sorted and turned into a Burrows-Wheeler transform whose ranks are
kept in a wavelet matrix. The benchmark's windows, a bounded block at a time, are matched by
backward search, all windows at once; occurrences are located by walking to sampled suffix
positions; their spans are merged per text and can be cut out of it.

Only runs of benchmark words long enough to hold the shortest window enter the index, since no
occurrence can reach outside them; a separator stands for all that lies between. Of the windows
only those are searched of which the shard has every word. This leaves nothing out, and texts of
other words cost little more than their tokens, however large the benchmark is.

Defined results: null texts and items have no words; an item of fewer words than a window is
one window; an item without words never occurs; rows of one id are one item, however the blocks
fall; items with a null id hit, but aren't counted or listed; repeated rows get equal results; empty tables give empty results or no hits. A text
longer than a shard is a shard by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import NOT_ALNUM, Tokenizer, cut, ranges, text_runs

WINDOW = 10
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Words of the benchmark in a block; each block is a pass over the documents of its own.
BLOCK_WORDS = 1_000_000
#: Every so many suffix positions are kept.
SAMPLE = 16


class Phrases:
    """A block of the benchmark: sorted word hashes, distinct windows as symbols, the items of each."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int = WINDOW):
        tokenizer = Tokenizer(NOT_ALNUM)
        words: list[np.ndarray] = []
        for i, j, data, offsets in text_runs(texts):
            t = tokenizer(data, offsets)
            words += [t.hash[a:b] for a, b in zip(np.searchsorted(t.doc, np.arange(j - i)), np.searchsorted(t.doc, np.arange(j - i), side="right"), strict=True)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=np.uint64)
        owners: dict[bytes, set[int]] = {}
        number = {name: k for k, name in enumerate(dict.fromkeys(ids))}  # rows of one id are one item
        self.ids = list(number)
        for name, hashes in zip(ids, words, strict=True):
            symbols = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
            for at in range(max(len(symbols) - window + 1, min(len(symbols), 1))):
                owners.setdefault(symbols[at : at + window].tobytes(), set()).add(number[name])
        self.lengths = np.array([len(k) // 4 for k in owners], dtype=np.int64)
        self.symbols = np.zeros((len(owners), window), dtype=np.int32)
        for row, key in enumerate(owners):
            self.symbols[row, window - len(key) // 4 :] = np.frombuffer(key, dtype=np.int32)
        self.item_start = np.concatenate([[0], np.cumsum([len(v) for v in owners.values()])]).astype(np.int64)
        self.items = np.array([i for v in owners.values() for i in sorted(v)], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(owners) else 0
        # Each window is filed under the word of it that the fewest windows hold.
        held = np.bincount(self.symbols.ravel(), minlength=len(self.vocabulary) + 1)
        held[0] = len(self.symbols) * window + 1
        key = self.symbols[np.arange(len(self.symbols)), held[self.symbols].argmin(axis=1)] if len(owners) else np.zeros(0, dtype=np.int64)
        self.filed = np.argsort(key, kind="stable")
        self.files = np.searchsorted(key[self.filed], np.arange(len(self.vocabulary) + 2))

    def possible(self, symbols: np.ndarray) -> np.ndarray:
        """The windows of which every word is among the symbols; others aren't even looked at, but for those filed under one of them."""
        distinct = np.unique(symbols)
        present = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        present[distinct] = True
        present[0] = True  # the padding of short windows
        near = self.filed[ranges(self.files[distinct], self.files[distinct + 1] - self.files[distinct])]
        return np.sort(near[present[self.symbols[near]].all(axis=1)])


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector per level, most significant bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.zeros((self.n >> 6) * 8 + 16, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        start, stop = np.zeros_like(at), at
        for level in range(self.bits):
            bit = (symbols >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, start), self._ones(level, stop)
            start = np.where(bit, self.zeros[level] + a, start - a)
            stop = np.where(bit, self.zeros[level] + b, stop - b)
        return stop - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = (out << 1) | bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only groups that still tie are sorted again.

    The last symbol must be the least and must not occur elsewhere.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = text[order][1:] != text[order][:-1]
    slot = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slot
    k = 1
    while not head.all():
        tied = ~head
        tied[:-1] |= ~head[1:]
        places = np.flatnonzero(tied)
        at = order[places]
        key = (rank[at] << np.int64(32)) | rank[np.minimum(at + k, n - 1)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        first = np.ones(len(at), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        head[places] |= first
        slots = np.maximum.accumulate(np.where(first, places, 0))
        rank[at] = slots
        k *= 2
    return order


class FMIndex:
    """Backward search over runs of symbols 1..sigma; runs are kept apart by separators."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sigma: int):
        """starts, lengths: the runs of ``symbols`` to index."""
        runs = len(starts)
        n = int(lengths.sum()) + runs
        stop = np.cumsum(lengths + 1) - 1  # where each run's separator stands
        self.origin = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[stop] = False
        self.origin[inside] = ranges(starts, lengths)
        plain = np.zeros(n, dtype=np.int64)
        plain[inside] = symbols[self.origin[inside]]
        unique = plain + runs
        unique[stop] = np.arange(runs)[::-1]  # each separator ends its suffixes; the last is the least
        order = suffix_array(unique)
        before = plain[order - 1]
        before[order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=sigma + 1))])
        self.ranks = WaveletMatrix(before, max(1, int(sigma).bit_length()))
        kept = (order % SAMPLE == 0) | (plain[order - 1] == 0) | (order == 0)
        self.sampled = kept
        self.sample_rank = np.cumsum(kept) - 1
        self.samples = order[kept]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all patterns, which are aligned to the right."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        active = np.arange(len(patterns))
        for step in range(width):
            active = active[(lengths[active] > step) & (low[active] < high[active])]
            if not len(active):
                break
            s = patterns[active, width - 1 - step].astype(np.int64)
            low[active] = self.first[s] + self.ranks.rank(s, low[active])
            high[active] = self.first[s] + self.ranks.rank(s, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the original sequence where the suffixes of ``rows`` begin."""
        out, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            done = self.sampled[here]
            ended = left[done]
            out[ended] = self.samples[self.sample_rank[here[done]]] + steps[ended]
            left, here = left[~done], here[~done]
            s = self.ranks.access(here)
            rows[left] = self.first[s] + self.ranks.rank(s, here)
            steps[left] += 1
        return self.origin[out]


def occurrences(symbols: np.ndarray, docs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of a window within one text. symbols: 0 for other words."""
    none = np.zeros(0, dtype=np.int64)
    if not phrases.shortest or not len(symbols):
        return none, none
    known = symbols > 0
    fresh = known.copy()
    fresh[1:] &= ~known[:-1] | (docs[1:] != docs[:-1])
    starts = np.flatnonzero(fresh)
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (docs[1:] != docs[:-1])
    lengths = np.flatnonzero(ends) + 1 - starts
    enough = lengths >= phrases.shortest
    if not enough.any():
        return none, none
    starts, lengths = starts[enough], lengths[enough]
    asked = phrases.possible(symbols[ranges(starts, lengths)])
    if not len(asked):
        return none, none
    index = FMIndex(symbols, starts, lengths, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols[asked], phrases.lengths[asked])
    return index.locate(ranges(low, high - low)), np.repeat(asked, high - low)


def blocks(benchmark: DataFrame, text_column: str = "text") -> list[DataFrame]:
    """The benchmark's distinct (id, text) in blocks of about BLOCK_WORDS words, chosen by a hash of the item; none is read yet."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce(text_column, F.lit("")).alias("text")).distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(words / BLOCK_WORDS))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) for b in range(n)]


def _shared(spark: SparkSession, block: DataFrame) -> Broadcast:
    table = block.toArrow()
    return spark.sparkContext.broadcast(Phrases(table["id"].to_pylist(), table["text"]))  # a block, so of bounded size


def _scan_block(docs: DataFrame, shared: Broadcast) -> DataFrame:
    names = docs.columns
    fields = docs.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokenizer = shared.value, Tokenizer(NOT_ALNUM)
        for batch in batches:
            n_words, n_hit = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            items: list[list[str]] = [[] for _ in range(len(batch))]
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            for i, j, data, offsets in text_runs(batch.column("text"), SHARD_BYTES):
                t = tokenizer(data, offsets)
                n_words[i:j] = np.bincount(t.doc, minlength=j - i)
                if not len(block.vocabulary):
                    continue
                at = np.minimum(np.searchsorted(block.vocabulary, t.hash), len(block.vocabulary) - 1)
                symbols = np.where(block.vocabulary[at] == t.hash, at + 1, 0).astype(np.int32)
                place, window = occurrences(symbols, t.doc, block)
                if not len(place):
                    continue
                edge = np.zeros(len(symbols) + 1, dtype=np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + block.lengths[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                n_hit[i:j] = np.bincount(t.doc[hit], minlength=j - i)
                pairs = np.unique(t.doc[place] * len(block.lengths) + window)
                doc, w = np.divmod(pairs, len(block.lengths))
                many = np.diff(block.item_start)[w]
                owners = np.unique(np.repeat(doc, many) * (len(block.ids) + 1) + block.items[ranges(block.item_start[w], many)])
                for d, k in zip(*np.divmod(owners, len(block.ids) + 1), strict=True):
                    if block.ids[k] is not None:  # as in SQL, an item without an id hits, but isn't counted
                        items[i + d].append(block.ids[k])
                opens = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (t.doc[1:] == t.doc[:-1])]))
                closes = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (t.doc[1:] == t.doc[:-1]), [False]]))
                for a, b in zip(opens, closes, strict=True):
                    d = t.doc[a]
                    spans[i + d].append({"start": int(t.start[a] - offsets[d]), "stop": int(t.end[b] - offsets[d])})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                [*names, "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(apply, f"{schema}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>")


_MERGED = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:long,stop:long>>),
  (acc, s) -> if(size(acc) > 0 and s.start <= element_at(acc, -1).stop,
    concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))),
    concat(acc, array(s))))"""


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (with a ``text``) and n_words, n_hit, items (array of ids) and spans (bytes of the text, merged).

    With several blocks each is built, broadcast, scanned for and released before the next, and
    the counts of hit words come from the merged spans of all blocks.
    """
    spark = docs.sparkSession
    every = blocks(benchmark)
    if len(every) == 1:
        return _scan_block(docs, _shared(spark, every[0]))
    names = docs.columns
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    parts = []
    for k, block in enumerate(every):
        shared = _shared(spark, block)
        part = _scan_block(rows.select("_row", "text"), shared).drop("text")
        parts.append(cut(part if k == 0 else part.where("n_hit > 0")))  # the first has every row
        shared.destroy()
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.expr(_MERGED).alias("spans"),
    )
    inner = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    piece = F.transform("spans", lambda s: F.regexp_count(F.substring(F.col("text").cast("binary"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).cast("string"), F.lit(inner)).cast("long"))
    counted = F.aggregate(piece, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.join(merged, "_row").select(*names, "n_words", counted.alias("n_hit"), "items", "spans")


def _spans(data: np.ndarray, offsets: np.ndarray, block: Phrases, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, byte after the last) of each merged span of windows, in order, and the words of each text."""
    t = tokenizer(data, offsets)
    known = np.minimum(np.searchsorted(block.vocabulary, t.hash), max(len(block.vocabulary) - 1, 0))
    symbols = np.where(block.vocabulary[known] == t.hash, known + 1, 0).astype(np.int32) if len(block.vocabulary) else np.zeros(len(t.hash), dtype=np.int32)
    place, window = occurrences(symbols, t.doc, block)
    edge = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + block.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    joined = hit[:-1] & hit[1:] & (t.doc[1:] == t.doc[:-1])
    opens, closes = np.flatnonzero(hit & ~np.append(False, joined)[: len(hit)]), np.flatnonzero(hit & ~np.append(joined, False)[: len(hit)])
    return t.doc[opens], t.start[opens] - offsets[t.doc[opens]], t.end[closes] - offsets[t.doc[closes]], np.bincount(t.doc, minlength=len(offsets) - 1)


def _cut_out(data: np.ndarray, offsets: np.ndarray, block: Phrases, tokenizer: Tokenizer) -> dict[int, tuple[bytes, bool]]:
    """The texts of a run that have windows, by place, without them, and whether words are left.

    What is left is searched again, since a cut makes its two sides neighbours.
    """
    done: dict[int, tuple[bytes, bool]] = {}
    places = np.arange(len(offsets) - 1)
    doc, start, stop, _ = _spans(data, offsets, block, tokenizer)
    while len(doc):
        hit, raws = np.unique(doc), []
        for k in hit:
            raw, own = data[offsets[k] : offsets[k + 1]].tobytes(), slice(*np.searchsorted(doc, [k, k + 1]))
            raws.append(b"\n".join(raw[i:j] for i, j in zip([0, *stop[own]], [*start[own], len(raw)], strict=True)))
        places = places[hit]
        data, offsets = np.frombuffer(b"".join(raws), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        doc, start, stop, words = _spans(data, offsets, block, tokenizer)
        done |= {int(place): (raw, bool(n)) for place, raw, n in zip(places, raws, words, strict=True)}
    return done


def _cut_block(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """docs with the block's windows cut out of ``text``; ``_cut`` says whether there were any, ``_left`` whether words are left."""
    names = [c for c in docs.columns if c not in ("_cut", "_left")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokenizer = shared.value, Tokenizer(NOT_ALNUM)
        for batch in batches:
            text = batch.column("text")
            hit, left = np.zeros(len(batch), dtype=bool), np.ones(len(batch), dtype=bool)
            new: dict[int, str] = {}
            for i, _, data, offsets in text_runs(text, SHARD_BYTES):
                for k, (raw, words) in _cut_out(data, offsets, block, tokenizer).items():
                    hit[i + k], left[i + k], new[i + k] = True, words, raw.decode()
            if new:
                texts = text.to_pylist()
                for k, x in new.items():
                    texts[k] = x
                text = pa.array(texts, text.type)
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else batch.column(c) for c in names), pa.array(hit), pa.array(left)], [*names, "_cut", "_left"])

    return docs.mapInArrow(apply, f"{schema}, _cut boolean, _left boolean")


def remove(docs: DataFrame, benchmark: DataFrame, n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every occurrence of a window cut out of the text (a line break stays in its place), until none is left.

    A text of which no word is left is dropped; texts without hits are kept as they are. With
    several blocks, the blocks are gone through again until a whole round cuts nothing.
    """
    spark, names = docs.sparkSession, docs.columns
    every = blocks(benchmark)
    kind = docs.schema[n_chars].dataType if n_chars in names else None
    resized = lambda df: df.withColumn(n_chars, F.when(F.col("_cut"), F.length("text").cast(kind)).otherwise(F.col(n_chars))) if kind else df
    if len(every) == 1:
        return resized(_cut_block(docs, _shared(spark, every[0]))).where("_left").select(*names)
    while True:
        cuts = 0
        for block in every:
            shared = _shared(spark, block)
            docs = cut(resized(_cut_block(docs, shared)).where("_left"))
            shared.destroy()
            cuts += docs.where("_cut").count()
            docs = docs.select(*names)
        if not cuts:
            return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
