"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its shingles of five words, each weighing its frequency in the text
times a smoothed inverse document frequency. Consistent weighted samples of that set agree
between two texts with the probability of their weighted Jaccard similarity; bands of samples
are the buckets. Texts that meet in a bucket are compared exactly, by Σ min / Σ max over the weights
and over the bare frequencies, and are similar if either reaches SIMILARITY: so shingles that a
large group of copies makes common can't make its own members look less alike.

Document frequencies come from a count sketch of fixed size over all texts: a shingle's share of
the texts is its cell's count, less the cell's expected load, over the number of texts. The
expected error of a share doesn't grow with the corpus, and shares below COMMON weigh alike, so
the weights mean the same at every size.

Equal texts are taken once. In a bucket every text is first compared with the least one; only a
bucket that still holds texts of different classes has all its texts compared with each other,
block by block inside tasks, which report the links that join them and no other pairs. So a
group of n copies costs n comparisons, pairs are never rows, and no link between different texts
that met is lost to the classes, which are the connected components.

Rows are told apart by a number of their own, so ids may repeat or be null. A class is named
by the least id of its rows (null if none has one), and one row of it is kept: that of the least
id, of these the longest text.

Defined results: null texts and texts without words form no group, so their rows are kept; a
text of fewer than five words is one shingle; equal texts that have words are one class, with or
without ids; rows that share an id but hold unlike texts are in different classes, which may then
bear the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NOT_ALNUM, Tokenizer, Tokens, cut, mix, text_runs
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 9, 3
#: Cells of the document-frequency sketch, and the segments in which it is summed.
CELLS, SEGMENTS = 1 << 20, 64
#: Share of the texts up to which a shingle counts as rare.
COMMON = 1e-3
#: How much more a rare shingle weighs than one that every text holds.
IDF_SPAN = 0.25
#: Members of a class that are compared with one text are dealt over so many tasks.
SALTS = 64
#: A bucket of several classes is compared in blocks of about so many texts and bytes.
BUCKET_TEXTS, BUCKET_BYTES = 1000, 8 << 20

_BLOCK = 1 << 15


def shingles(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle hash, frequency) of each distinct shingle of each text, by text."""
    n = np.bincount(t.doc, minlength=t.docs)
    first = np.cumsum(n) - n
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(t.docs), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    value = np.zeros(len(doc), dtype=np.uint64)
    padded = np.concatenate([t.hash, np.zeros(SHINGLE, dtype=np.uint64)])
    for k in range(SHINGLE):
        inside = np.where(k < n[doc], padded[start + k], np.uint64(0))
        value = value * np.uint64(0x9DDFEA08EB382D69) + inside
    value = mix(value, 11)
    docs, hashes, times = [], [], []
    edges = np.concatenate([[0], np.cumsum(counts)])
    for d in np.flatnonzero(counts):
        u, c = np.unique(value[edges[d] : edges[d + 1]], return_counts=True)
        hashes.append(u)
        times.append(c)
        docs.append(len(u))
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    return np.repeat(np.flatnonzero(counts), docs), np.concatenate(hashes), np.concatenate(times)


class Weights:
    """Inverse document frequencies from the summed sketch."""

    def __init__(self, cells: np.ndarray, texts: int):
        total = float(cells.sum())
        spare = (total - cells) / max(len(cells) - 1, 1)
        share = np.maximum(cells - spare, 1.0) / max(texts, 1)
        self.table = (1.0 + IDF_SPAN * np.log(np.clip(share, COMMON, 1.0)) / np.log(COMMON)).astype(np.float32)

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.table[(hashes >> np.uint64(44)).astype(np.int64)] * times.astype(np.float32)


def document_frequencies(docs: DataFrame) -> Weights:
    """Sums the sketch over all texts of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cells, texts = Tokenizer(NOT_ALNUM), np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text")):
                t = tokenizer(data, offsets)
                doc, hashes, _ = shingles(t)
                cells += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                texts += len(np.unique(doc))
        if texts:
            parts = cells.reshape(SEGMENTS, -1)
            blobs = [zstandard.ZstdCompressor(level=1).compress(p.astype(np.int32).tobytes()) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(blobs, pa.binary()), pa.array([texts] + [0] * (SEGMENTS - 1), pa.int64())], ["segment", "cells", "texts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        texts: dict[int, int] = {}
        for batch in batches:
            for segment, blob, n in zip(batch.column("segment").to_pylist(), batch.column("cells"), batch.column("texts").to_pylist(), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), dtype=np.int32)
                sums[segment] = sums.get(segment, 0) + part.astype(np.int64)
                texts[segment] = texts.get(segment, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array([texts[s] for s in sums], pa.int64())], ["segment", "cells", "texts"])

    schema = "segment int, cells binary, texts long"
    summed = docs.select("text").mapInArrow(count, schema).repartition(SEGMENTS, "segment").mapInArrow(total, schema).collect()  # SEGMENTS rows, CELLS numbers
    cells, texts = np.zeros((SEGMENTS, CELLS // SEGMENTS)), 0
    for r in summed:
        cells[r["segment"]] = np.frombuffer(r["cells"], dtype=np.int64)
        texts += r["texts"]
    return Weights(cells.ravel(), texts)


def band_hashes(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their band hashes as int64 rows).

    Per sample and shingle r and c are Gamma(2, 1) and b is uniform, all drawn from the
    shingle's hash; t = floor(ln w / r + b), and the shingle of the least
    ln c - r (t - b + 1) is sampled, together with t.
    """
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    present = doc[edges]
    log_w = np.log(weights)
    samples = np.empty((BANDS * ROWS, len(present)), dtype=np.uint64)
    least = np.empty(len(hashes), dtype=np.uint64)
    tiny, scale = np.float32(2.0**-25), np.float32(2.0**-24)
    low24 = np.uint64(0xFFFFFF)
    for j in range(BANDS * ROWS):
        for at in range(0, len(hashes), _BLOCK):
            h, lw = hashes[at : at + _BLOCK], log_w[at : at + _BLOCK]
            z = (h ^ np.uint64((j * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            z ^= z >> np.uint64(29)
            y = z * np.uint64(0xC2B2AE3D27D4EB4F)
            y ^= y >> np.uint64(31)
            u = (z & low24).astype(np.float32) * scale + tiny
            u *= ((z >> np.uint64(24)) & low24).astype(np.float32) * scale + tiny
            r = -np.log(u)
            b = (z >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
            u = (y & low24).astype(np.float32) * scale + tiny
            u *= ((y >> np.uint64(24)) & low24).astype(np.float32) * scale + tiny
            t = np.floor(lw / r + b)
            a = np.log(-np.log(np.minimum(u, np.float32(1 - 2.0**-23)))) - r * (t - b + np.float32(1))
            bits = a.view(np.uint32)
            bits = np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
            mark = (h + t.astype(np.int64).view(np.uint64) * np.uint64(0x9DDFEA08EB382D69)) * np.uint64(0xFF51AFD7ED558CCD)
            least[at : at + _BLOCK] = (bits << np.uint64(32)) | (mark >> np.uint64(32))
        samples[j] = np.minimum.reduceat(least, edges) & np.uint64(0xFFFFFFFF)
    out = np.empty((len(present), BANDS), dtype=np.int64)
    for band in range(BANDS):
        h = np.full(len(present), band + 1, dtype=np.uint64)
        for k in range(ROWS):
            h = mix(h ^ samples[band * ROWS + k], k + 1)
        out[:, band] = h.view(np.int64)
    return present, out


def numbered(docs: DataFrame) -> DataFrame:
    """docs and _row, a number for each row; written once, as a second reading may number otherwise."""
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """_row, doc_id, h1, h2 (of the text) and bands (array, null without words) for each row of docs (_row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # CELLS numbers
    rows = docs.select("_row", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"), F.octet_length("text").cast("long").alias("size"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, idf = Tokenizer(NOT_ALNUM), shared.value
        for batch in batches:
            bands: list = [None] * len(batch)
            for i, j, data, offsets in text_runs(batch.column("text")):
                doc, hashes, times = shingles(tokenizer(data, offsets))
                if len(doc):
                    present, found = band_hashes(doc, hashes, idf.of(hashes, times), j - i)
                    for d, row in zip(present, found, strict=True):
                        bands[i + d] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "doc_id", "h1", "h2", "size")), pa.array(bands, pa.list_(pa.int64()))], ["_row", "doc_id", "h1", "h2", "size", "bands"])

    return rows.mapInArrow(apply, "_row long, doc_id long, h1 long, h2 long, size long, bands array<long>")


def alike(common, left, right):
    """Whether the Jaccard similarity of two sets reaches SIMILARITY: what they share and what each weighs, as numbers or arrays."""
    return common >= SIMILARITY * (left + right - common) * (1 - 1e-6)


def similar(pairs: DataFrame, docs: DataFrame, weights: Weights) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts in docs (_row, text) are similar.

    Each text is sent once to every task where it is compared: b's texts are grouped under a,
    dealt over SALTS tasks at most, with a's own text in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    want = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    asked = want.select("a", "salt", "b", F.col("b").alias("_row")).unionByName(want.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("_row")).distinct())
    texts = docs.select("_row", "text").join(asked, "_row").select("a", "salt", "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, idf = Tokenizer(NOT_ALNUM), shared.value
        head, key = None, None
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            left, right = [], []
            for i, j, data, offsets in text_runs(batch.column("text")):
                doc, hashes, times = shingles(tokenizer(data, offsets))
                w = idf.of(hashes, times)
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    own = slice(edges[k - i], edges[k - i + 1])
                    if b[k] is None:
                        head, key = (hashes[own], w[own], times[own]), (a[k], salt[k])
                    elif key == (a[k], salt[k]) and len(head[0]):
                        at = np.minimum(np.searchsorted(head[0], hashes[own]), len(head[0]) - 1)
                        both = head[0][at] == hashes[own]
                        if any(alike(float(np.minimum(x[at], y[own])[both].sum()), float(x.sum()), float(y[own].sum())) for x, y in ((head[1], w), (head[2], times))):
                            left.append(a[k])
                            right.append(b[k])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(compare, "a long, b long")


def joined(hashes: list[np.ndarray], weights: list[np.ndarray], times: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of similar texts that join all texts whose similarity links are connected."""
    n = len(hashes)
    owner = np.repeat(np.arange(n), [len(h) for h in hashes])
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
    runs = [(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True) if j - i > 1]
    close = np.zeros((n, n), dtype=bool)
    for measure in (weights, times):
        totals = np.array([m.sum() for m in measure], dtype=np.float64)
        value = np.concatenate(measure)[order].astype(np.float32)
        common = np.zeros((n, n), dtype=np.float32)
        for i, j in runs:
            at, m = owner[i:j], value[i:j]
            common[at[:, None], at] += np.minimum(m[:, None], m)
        close |= alike(common, totals[:, None], totals)
    root, links = np.arange(n), []
    for i in range(n):
        for j in np.flatnonzero(close[i, i + 1 :] & (root[i + 1 :] != root[i])) + i + 1:
            if root[i] != root[j]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def within_buckets(members: DataFrame, docs: DataFrame, weights: Weights) -> DataFrame:
    """Links (a, b) that join the similar texts of each bucket. members: bucket, b (row number), size (bytes).

    A large bucket is dealt into blocks, and each pair of its blocks is compared by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    sizes = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BUCKET_TEXTS), F.ceil(F.sum("size") / BUCKET_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", F.col("b").alias("_row"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    blocks = dealt.select("bucket", "_row", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    texts = docs.select("_row", "text").join(blocks, "_row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, idf = Tokenizer(NOT_ALNUM), shared.value
        key, ids, hashes, ws, counts = None, [], [], [], []

        def done() -> pa.RecordBatch:
            found = joined(hashes, ws, counts)
            return pa.RecordBatch.from_arrays([pa.array([min(ids[i], ids[j]) for i, j in found], pa.int64()), pa.array([max(ids[i], ids[j]) for i, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high")), strict=True))
            names = batch.column("_row").to_pylist()
            for i, j, data, offsets in text_runs(batch.column("text")):
                doc, found, times = shingles(tokenizer(data, offsets))
                w = idf.of(found, times)
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    if keys[k] != key:
                        if len(ids) > 1:
                            yield done()
                        key, ids, hashes, ws, counts = keys[k], [], [], [], []
                    own = slice(edges[k - i], edges[k - i + 1])
                    ids.append(names[k])
                    hashes.append(found[own].copy())
                    ws.append(w[own].copy())
                    counts.append(times[own].copy())
        if len(ids) > 1:
            yield done()

    return texts.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "_row").mapInArrow(compare, "a long, b long")


def classes(rows: DataFrame) -> DataFrame:
    """_row, doc_id, class_id (least id of the class) and kept (true for one row of a class), for each row of rows (_row, doc_id, text)."""
    named = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    weights = document_frequencies(named)
    signed = cut(signatures(named, weights))
    worded = signed.where(F.col("bands").isNotNull())
    # Of a class the row that compares least is kept.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", (-F.col("size")).alias("shorter"), "h1", "h2", "_row")
    texts = worded.groupBy("h1", "h2").agg(F.min("_row").alias("rep"), F.min("bands").alias("bands"), F.min("size").alias("size"), F.min(place).alias("first"))
    buckets = cut(texts.select("rep", "size", F.explode("bands").alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("bucket", "a")
    met = cut(buckets.join(shared, "bucket").select("bucket", "a", F.col("rep").alias("b"), "size"))
    links = cut(similar(met.where("a < b").select("a", "b").distinct(), named, weights))
    rooted = components(links)
    placed = met.join(rooted.withColumnRenamed("node", "b"), "b", "left").select("bucket", "b", "size", F.coalesce("root", "b").alias("class"))
    split = placed.groupBy("bucket").agg(F.min("class").alias("_least"), F.max("class").alias("_most"), F.count("*").alias("_n")).where("_least < _most and _n > 2").select("bucket")
    mixed = cut(placed.join(split, "bucket", "left_semi"))
    if mixed.limit(1).count():
        more = cut(within_buckets(mixed, named, weights))
        if more.limit(1).count():
            rooted = components(links.unionByName(more))
    of_text = texts.select("h1", "h2", "rep", "first").join(rooted.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "first", F.coalesce("root", "rep").alias("root"))
    of_text = cut(of_text)
    firsts = of_text.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first._row").alias("keeper"))
    of_class = cut(of_text.select("h1", "h2", "root").join(firsts, "root").drop("root"))
    classed = worded.select("_row", "doc_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("_row", "doc_id", "class_id", (F.col("_row") == F.col("keeper")).alias("kept"))
    return classed.unionByName(signed.where(F.col("bands").isNull()).select("_row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for each row of docs."""
    return classes(numbered(docs.select("doc_id", "text"))).select("doc_id", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, and all rows without words."""
    rows = numbered(docs)
    return rows.join(classes(rows).where("kept").select("_row"), "_row", "left_semi").select(*docs.columns)
