"""Katz backoff language model: Good-Turing discounted bigrams, exactly normalised backoff weights.

Every word that occurs in the training texts has counts of its own, as history and as follower.
A token's probability is evaluated recursively: the discounted bigram if it was seen; else the
history's backoff weight times the discounted unigram; a word that was never seen takes the mass
that the unigrams' discounts leave. Each level sums to one, unseen words being one event.

Counts are tables dealt by hash bucket: words by their hash, bigrams by their history. Buckets
hold about BUCKET_BYTES of text each, so there are more of them, not larger ones, as the corpus
grows; the followers of a history that would fill more than half a bucket are dealt over as many
buckets as it needs, and its sums are combined before use. A bigram's history bucket needs its
follower's unigram: words that make up RARE_SHARE of the tokens are at most 1 / RARE_SHARE and are
broadcast with their counts, the others are asked for at their own bucket. This list saves
messages; no result depends on it.

To score, each run of texts sends its distinct bigrams and rarer words, with the texts they occur
in, to the buckets that hold their counts; a bucket answers with a sum per text, and a text's sums
are added up. A row per n-gram and text would take several times the disk, so keys travel in
compressed columns of a message. Nothing whole passes through the driver but the broadcast list,
count-of-count statistics, and sums of the histories that are dealt over several buckets.

Defined results: a null text is the empty text, which is one end token; null ids are learned
from; without any training text the score is the base score; repeated rows each get a row and
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WHITE, Tokenizer, Tokens, cut, held_out, mix, ranges, task_count, text_runs

FOLD = (5, 1)
#: Words of at least this share of the tokens are broadcast.
RARE_SHARE = 3e-7
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Bytes of text whose counts fall into one bucket, on average.
BUCKET_BYTES = 24 << 20
#: Text bytes that are turned into one set of messages.
RUN_BYTES = 6 << 20
#: Distinct keys that a counting task holds before it passes them on.
PENDING = 2_000_000

END, START, FIRST = 1, 2, 3
#: Words that aren't broadcast are named by their hash with this bit set, the others by small numbers.
TOP = np.uint64(1 << 63)
MESSAGE = "kind int, bucket int, step int, chunk long, blob binary"
DIRECT, META, TAIL, PAIR = 0, 1, 2, 3
COUNTS, UNIGRAMS, ASKED = 0, 1, 2

_U = np.uint64


def _pack(*arrays: np.ndarray | None) -> bytes:
    """Arrays as compressed columns: of each its type, its length, and its bytes place by place, so that high bytes, which are alike, lie together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a is None:
            out.append(struct.pack("<cBQ", b"-", 1, 0))
            continue
        a = np.ascontiguousarray(a)
        out += [struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray | None]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, size, n = struct.unpack_from("<cBQ", raw, at)
        at += struct.calcsize("<cBQ")
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * n, offset=at).reshape(size, n)
        out.append(None if kind == b"-" else np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{kind.decode()}{size}")))
        at += size * n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "step", "chunk", "blob"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows of sorted columns begin."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs as each first once, how many seconds it has, and the seconds."""
    at = _starts(first)
    return first[at], np.diff(np.append(at, len(first))).astype(np.uint32), second


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=_U(0))


def _pack_pairs(first: np.ndarray, second: np.ndarray, *more: np.ndarray) -> bytes:
    unique, n, second = _grouped(first, second)
    return _pack(_deltas(unique), n, second, *more)


def _unpack_pairs(blob: bytes) -> tuple:
    unique, n, second, *more = _unpack(blob)
    return np.repeat(np.cumsum(unique, dtype=np.uint64), n), second, *more


def _merge(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of the columns with the sums of their counts."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns, counts = [c[order] for c in columns], counts[order]
    at = _starts(*columns)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


def good_turing(n: list[int]) -> dict[int, float]:
    """Katz's discount for counts 1..k from the numbers n[r] of types that occur r times.

    Where the counts of counts don't fall as they should, a plain discount of half a count is used.
    """
    k = DISCOUNTED
    if n[1] > 0 and all(n[r] > 0 for r in range(1, k + 2)):
        common = (k + 1) * n[k + 1] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else -1 for r in range(1, k + 1)}
        if all(0 < x < 1 for x in d.values()):
            return d
    return {r: 1 - 0.5 / r for r in range(1, k + 1) if n[r] > 0}


def _factors(discount: dict[int, float]) -> np.ndarray:
    out = np.ones(DISCOUNTED + 2)
    for r, d in discount.items():
        out[r] = d
    return out


def _effective(counts: np.ndarray, discount: dict[int, float]) -> np.ndarray:
    return counts * _factors(discount)[np.minimum(counts, DISCOUNTED + 1)]


class Words:
    """The unigram level, and the names of words: broadcast words have small numbers from FIRST on."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, total: int, ends: int, distinct: int, n: list[int], buckets: int):
        by_count = np.argsort(-counts, kind="stable")  # the more frequent, the smaller the number, and the shorter what it compresses to
        order = np.argsort(frequent[by_count])
        self.frequent, self.number = frequent[by_count][order], (order + FIRST).astype(np.uint64)
        self.total, self.ends, self.distinct, self.buckets = total, ends, distinct, buckets
        self.counts = np.concatenate([[0, ends, 0], counts[by_count]]).astype(np.int64)
        self.discount = good_turing(n)
        self.unseen = sum((1 - d) * r * n[r] for r, d in self.discount.items()) / max(total, 1)
        self.scale = 1.0
        if self.unseen < 1e-9:  # nothing is discounted: half a count is set aside
            self.scale = total / (total + 0.5)
            self.unseen = 1 - self.scale
        share = self.counts / max(total, 1)
        share[START] = share[END]
        #: Over how many buckets the followers of each broadcast word are dealt.
        self.spread = np.where(share * buckets > 0.5, np.ceil(2 * share * buckets), 1).astype(np.uint64)
        self.hot = np.flatnonzero(self.spread > 1)

    def names(self, hashes: np.ndarray) -> np.ndarray:
        codes = hashes | TOP
        if not len(self.frequent):
            return codes
        at = np.minimum(np.searchsorted(self.frequent, codes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == codes, self.number[at], codes)

    def p(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probabilities of words that occur so often; of 0, of all unseen words together."""
        known = _effective(counts, self.discount) * self.scale / max(self.total, 1)
        return np.where(counts > 0, known, max(self.unseen, 1e-300))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def word_bucket(self, names: np.ndarray) -> np.ndarray:
        return (mix(names, 9) % _U(self.buckets)).astype(np.int64)

    def pair_bucket(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        known = first < TOP
        spread = np.ones(len(first), dtype=np.uint64)
        spread[known] = self.spread[first[known].astype(np.int64)]
        return ((mix(first, 3) + mix(second, 5) % spread) % _U(self.buckets)).astype(np.int64)


def _tokens(t: Tokens, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, history, name) of every token with the end tokens, and the number of words of each text."""
    n = np.bincount(t.doc, minlength=t.docs)
    doc = np.repeat(np.arange(t.docs), n + 1)
    last = np.cumsum(n + 1) - 1
    second = np.full(len(doc), END, dtype=np.uint64)
    inside = np.ones(len(doc), dtype=bool)
    inside[last] = False
    second[inside] = words.names(t.hash)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[last - n] = START
    return doc, first, second, n


def _ordered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A stable order by (first, second), through their places among the names of this run, which fit one number."""
    names, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    key = (place[: len(first)].astype(np.uint64) << _U(32)) | place[len(first) :].astype(np.uint64)
    return np.argsort(key, kind="stable")


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows in order) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    at = _starts(bucket[order])
    for i, j in zip(at, np.append(at[1:], len(order)), strict=True):
        yield int(bucket[order[i]]), order[i:j]


def _counting(docs: DataFrame, keys_of: Callable, bucket_of: Callable, buckets: int) -> DataFrame:
    """Counts of keys over docs (text): map-side sums, then a row of sorted keys and counts for each bucket.

    keys_of: the key columns (one or two) of a run's tokens; bucket_of: the bucket of each key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pending, size = Tokenizer(WHITE), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _merge([np.concatenate(c) for c in zip(*[k for k, _ in pending], strict=True)], np.concatenate([c for _, c in pending]))
            pending.clear()
            return _batch([(0, b, COUNTS, 0, _table(keys, counts, at)) for b, at in _by_bucket(bucket_of(*keys), buckets)])

        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text"), RUN_BYTES):
                columns = keys_of(tokenizer(data, offsets))
                if not len(columns[0]):
                    continue
                order = _ordered(*columns) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
                columns = [c[order] for c in columns]
                at = _starts(*columns)
                pending.append(([c[at] for c in columns], np.diff(np.append(at, len(order)))))
                size += len(at)
                if size > PENDING:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a bucket come one after the other; sums are folded whenever they have doubled."""
        bucket, parts, size, folded = None, [], 0, 0

        def fold() -> tuple:
            return _merge([np.concatenate(c) for c in zip(*[k for k, _ in parts], strict=True)], np.concatenate([c for _, c in parts]))

        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if b != bucket:
                    if parts:
                        yield _batch([(0, bucket, COUNTS, 0, _table(*fold()))])
                    bucket, parts, size, folded = b, [], 0, 1 << 16
                keys, counts = _of_table(blob.as_py())
                parts.append((keys, counts))
                size += len(counts)
                if size > 2 * folded:
                    parts = [fold()]
                    size = len(parts[0][1])
                    folded = max(size, 1 << 16)
        if parts:
            yield _batch([(0, bucket, COUNTS, 0, _table(*fold()))])

    return docs.select("text").mapInArrow(count, MESSAGE).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(total, MESSAGE)


def _table(keys: list[np.ndarray], counts: np.ndarray, at: np.ndarray | slice = slice(None)) -> bytes:
    counts = counts[at].astype(np.uint64)
    return _pack(_deltas(keys[0][at]), counts) if len(keys) == 1 else _pack_pairs(keys[0][at], keys[1][at], counts)


def _of_table(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    columns = _unpack(blob)
    if len(columns) == 2:
        return [np.cumsum(columns[0], dtype=np.uint64)], columns[1].astype(np.int64)
    first, second, counts = _unpack_pairs(blob)
    return [first, second], counts.astype(np.int64)


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()


def _summed(table: DataFrame, measure: Callable[[bytes], list[tuple]]) -> dict[int, tuple[list[int], float]]:
    """Sums by history (-1: of all) of what ``measure`` finds in each row: (history, whole numbers, a fraction)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for blob in batch.column("blob") for x in measure(blob.as_py())]
            columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["history", "n", "seen"])

    sums = [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(DISCOUNTED + 3)]
    rows = table.mapInArrow(apply, "history long, n array<long>, seen double").groupBy("history").agg(*sums, F.sum("seen").alias("seen")).collect()
    return {r["history"]: ([r[f"n{i}"] or 0 for i in range(DISCOUNTED + 3)], r["seen"]) for r in rows}


def _frequent(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least ``least`` counts; by their share at most 1 / RARE_SHARE."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                (keys,), counts = _of_table(blob.as_py())
                keep = counts >= least
                yield _batch([(0, 0, 0, 0, _pack(keys[keep], counts[keep]))])

    parts = [_unpack(r["blob"]) for r in table.mapInArrow(pick, MESSAGE).select("blob").toLocalIterator()]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


def _hot_rows(first: np.ndarray, second: np.ndarray, words: Words) -> Iterator[tuple[int, slice]]:
    """The rows of each history, in sorted pairs, that is dealt over several buckets."""
    for h in words.hot[np.isin(words.hot.astype(np.uint64), first)]:
        yield int(h), slice(*np.searchsorted(first, [_U(h), _U(h + 1)]))


def _unigrams_of_followers(words: DataFrame, bigrams: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """For every bigram of a follower that isn't broadcast: how often the follower occurs. Bigrams ask at the followers' buckets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                (first, second), _ = _of_table(blob.as_py())
                rare = second >= TOP
                first, second = first[rare], second[rare]
                if len(first):
                    yield _batch([(0, to, ASKED, b, _pack_pairs(first[at], second[at])) for to, at in _by_bucket(shared.value.word_bucket(second), buckets)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = bucket = None
        for batch in batches:
            for b, step, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "step", "chunk", "blob")), strict=True):
                if step == COUNTS:
                    bucket, ((keys,), counts) = b, _of_table(blob)
                    continue
                assert bucket == b  # every follower was counted
                first, second = _unpack_pairs(blob)
                yield _batch([(PAIR, chunk, UNIGRAMS, 0, _pack_pairs(first, second, counts[np.searchsorted(keys, second)].astype(np.uint64)))])

    asked = bigrams.mapInArrow(ask, MESSAGE).unionByName(words)
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "step").mapInArrow(answer, MESSAGE)


class Backoff:
    """Probabilities of one bucket's bigrams, and the backoff weights of its histories.

    Of a follower that isn't broadcast the probability is told as a multiple of its unigram, since
    only the follower's own bucket knows the unigram of a word that nothing here was followed by.
    """

    def __init__(self, counted: list[bytes], unigrams: list[bytes], words: Words, discount: dict[int, float], hot: dict[int, tuple[list[int], float]]):
        self.words = words
        (first, second), counts = _of_table(counted[0]) if counted else ([np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64))
        rare = second >= TOP
        lower = np.empty(len(second))
        lower[~rare] = words.p(words.counts[second[~rare].astype(np.int64)])
        if rare.any():
            parts = [np.concatenate(c) for c in zip(*[_unpack_pairs(b) for b in unigrams], strict=True)]
            order = np.lexsort((parts[1], parts[0]))  # as the table's own rows
            lower[rare] = words.p(parts[2][order].astype(np.int64))
        effective = _effective(counts, discount)
        at = _starts(first)
        self.histories = first[at]
        total, held, seen = (np.add.reduceat(x, at).astype(float) if len(at) else np.zeros(0) for x in (counts, effective, lower))
        factors = _factors(discount)
        for i in np.flatnonzero(np.isin(self.histories, words.hot.astype(np.uint64))):
            n, whole = hot[int(self.histories[i])]
            total[i], seen[i] = n[0], whole
            held[i] = n[0] - sum((1 - factors[r]) * r * n[r + 1] for r in range(1, DISCOUNTED + 1))
        # Nothing discounted, though some word is unseen: half a count is set aside.
        scale = np.where(total - held < 1e-9 * np.maximum(total, 1), total / (total + 0.5), 1.0)
        rest = 1 - held * scale / np.maximum(total, 1e-300)
        self.weight = np.log10(rest / np.maximum(1 - seen, 1e-15))
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(first))))
        self.log_p = np.log10(effective * scale[group] / total[group]) if len(first) else np.zeros(0)
        self.log_p[rare] -= np.log10(lower[rare])
        key = mix(first, 1) ^ second
        order = np.argsort(key)
        self.key, self.first, self.second, self.log_p = key[order], first[order], second[order], self.log_p[order]

    def log10(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 of each bigram's probability; for followers that aren't broadcast, of its multiple of the unigram."""
        out = np.zeros(len(first))
        seen = np.zeros(len(first), dtype=bool)
        if len(self.key):
            key = mix(first, 1) ^ second
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            seen = (self.first[at] == first) & (self.second[at] == second)
            out[seen] = self.log_p[at[seen]]
            h = np.minimum(np.searchsorted(self.histories, first), len(self.histories) - 1)
            known = ~seen & (self.histories[h] == first)
            out[known] = self.weight[h[known]]
        plain = ~seen & (second < TOP)
        out[plain] += np.log10(self.words.p(self.words.counts[second[plain].astype(np.int64)]))
        return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id", *FOLD).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    size = rows.agg(F.count_if(~F.col("held_out")).alias("ends"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ends, buckets = size["ends"], max(task_count(spark), 2, -(-size["bytes"] // BUCKET_BYTES))
    unnamed = Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0, [0] * (DISCOUNTED + 2), buckets)

    words = cut(_counting(training, lambda t: (unnamed.names(t.hash),), unnamed.word_bucket, buckets))
    measured = _summed(words, lambda blob: [(-1, [int((c := _of_table(blob)[1]).sum()), len(c), *_count_of_counts(c)], 0.0)]).get(-1, ([0] * (DISCOUNTED + 3), 0.0))[0]
    total, distinct = measured[0] + ends, measured[1] + (ends > 0)
    types = [0, *measured[2:]]
    if 0 < ends < len(types):
        types[ends] += 1  # the end of a text is a word, too
    frequent, counts = _frequent(words, max(2, int(np.ceil(RARE_SHARE * total))))
    level = Words(frequent, counts, total, ends, distinct, types, buckets)
    shared = spark.sparkContext.broadcast(level)  # bounded by 1 / RARE_SHARE words

    bigrams = cut(_counting(training, lambda t: _tokens(t, shared.value)[1:3], lambda f, s: shared.value.pair_bucket(f, s), buckets))

    def of_counts(blob: bytes) -> list[tuple]:
        (first, second), c = _of_table(blob)
        known = shared.value
        out = [(-1, [int(c.sum()), len(c), *_count_of_counts(c)], 0.0)]
        for h, at in _hot_rows(first, second, known):
            plain = second[at][second[at] < TOP].astype(np.int64)
            out.append((h, [int(c[at].sum()), len(c[at]), *_count_of_counts(c[at])], float(known.p(known.counts[plain]).sum())))
        return out

    def of_unigrams(blob: bytes) -> list[tuple]:
        first, second, c = _unpack_pairs(blob)
        return [(h, [], float(shared.value.p(c[at].astype(np.int64)).sum())) for h, at in _hot_rows(first, second, shared.value)]

    found = _summed(bigrams, of_counts)
    discount = good_turing([0, *found[-1][0][2:]]) if found else {}
    unigrams = cut(_unigrams_of_followers(words, bigrams, shared, buckets))
    more = _summed(unigrams, of_unigrams) if len(level.hot) else {}
    hot = {h: (n, seen + more.get(h, ([], 0.0))[1]) for h, (n, seen) in found.items() if h >= 0}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = Tokenizer(WHITE), shared.value
        for batch in batches:
            chunk = int(batch.column("_row")[0].as_py()) if len(batch) else 0
            for i, j, data, offsets in text_runs(batch.column("text"), RUN_BYTES):
                doc, first, second, n = _tokens(tokenizer(data, offsets), known)
                plain = second < TOP
                c = known.counts[second[plain].astype(np.int64)]
                sums = [np.bincount(doc[plain], weights=x, minlength=j - i) for x in (c > 0, known.base(c))]
                ids = pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("held_out")[i:j]], ["doc_id", "held_out"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as writer:
                    writer.write_batch(ids)
                meta = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
                at = (chunk + i) % buckets
                out = [(META, at, ASKED, chunk + i, meta), (DIRECT, at, ASKED, chunk + i, _pack(n + 1.0, *sums, np.zeros(j - i)))]
                order = _ordered(first, second)
                doc, first, second = doc[order], first[order], second[order]
                each = _starts(first, second, doc)  # a bigram of a text
                times = np.diff(np.append(each, len(doc))).astype(np.uint32)
                doc, first, second = doc[each].astype(np.uint32), first[each], second[each]
                head = _starts(first, second)
                texts = np.diff(np.append(head, len(doc))).astype(np.uint32)
                for b, rows_of in _by_bucket(known.pair_bucket(first[head], second[head]), buckets):
                    taken = ranges(head[rows_of], texts[rows_of].astype(np.int64))
                    out.append((PAIR, b, ASKED, chunk + i, _pack_pairs(first[head[rows_of]], second[head[rows_of]], texts[rows_of], doc[taken], times[taken])))
                rare = np.flatnonzero(second >= TOP)
                rare = rare[np.lexsort((doc[rare], second[rare]))]
                head = _starts(second[rare])
                texts = np.diff(np.append(head, len(rare))).astype(np.uint32)
                for b, rows_of in _by_bucket(known.word_bucket(second[rare[head]]), buckets) if len(rare) else ():
                    taken = rare[ranges(head[rows_of], texts[rows_of].astype(np.int64))]
                    out.append((TAIL, b, ASKED, chunk + i, _pack(_deltas(second[rare[head[rows_of]]]), texts[rows_of], doc[taken], times[taken])))
                yield _batch(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's counts come first, then the messages that ask for them."""
        known, of, parts, model = shared.value, None, ([], []), None
        for batch in batches:
            out = []
            for kind, b, step, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "step", "chunk", "blob")), strict=True):
                if kind in (META, DIRECT):
                    out.append((kind, b, step, chunk, blob))
                    continue
                if (kind, b) != of:
                    of, parts, model = (kind, b), ([], []), None
                if step != ASKED:
                    parts[step].append(blob)
                    continue
                if kind == PAIR:
                    model = model or Backoff(*parts, known, discount, hot)
                    first, second, texts, doc, times = _unpack_pairs(blob)
                    weigh = lambda x: np.bincount(doc, weights=np.repeat(x, texts) * times)  # noqa: B023, E731
                    got = (None, None, None, weigh(model.log10(first, second)))
                else:
                    model = model or (_of_table(parts[COUNTS][0]) if parts[COUNTS] else ([np.zeros(0, np.uint64)], np.zeros(0, np.int64)))
                    names, texts, doc, times = _unpack(blob)
                    names, ((keys,), counted) = np.cumsum(names, dtype=np.uint64), model
                    at = np.minimum(np.searchsorted(keys, names), max(len(keys) - 1, 0))
                    c = np.where(keys[at] == names, counted[at], 0) if len(keys) else np.zeros(len(names), np.int64)
                    weigh = lambda x: np.bincount(doc, weights=np.repeat(x, texts) * times)  # noqa: B023, E731
                    got = (None, weigh(c > 0), weigh(known.base(c)), weigh(np.log10(known.p(c))))
                out.append((DIRECT, b, step, chunk, _pack(*got)))
            if out:
                yield _batch(out)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's rows come one after the other, its ids first."""
        chunk, ids, sums = None, None, None

        def done() -> pa.RecordBatch:
            n_tokens, n_known, base, model = sums
            columns = [ids.column("doc_id").combine_chunks(), ids.column("held_out").combine_chunks(), pa.array(n_tokens.astype(np.int64)), pa.array(np.rint(n_known).astype(np.int64)), pa.array(base), pa.array(model)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for kind, c, blob in zip(*(batch.column(x).to_pylist() for x in ("kind", "chunk", "blob")), strict=True):
                if c != chunk:
                    if ids is not None:
                        yield done()
                    chunk, ids = c, None
                if kind == META:
                    ids = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
                    sums = [np.zeros(len(ids)) for _ in range(4)]
                    continue
                for into, part in zip(sums, _unpack(blob), strict=True):
                    if part is not None:
                        into[: len(part)] += part
        if ids is not None:
            yield done()

    asked = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(ask, MESSAGE)
    tables = [words.withColumn("kind", F.lit(TAIL)), bigrams.withColumn("kind", F.lit(PAIR)), unigrams]
    messages = reduce(DataFrame.unionByName, [asked, *tables])
    answers = messages.repartition(2 * buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", "step").mapInArrow(answer, MESSAGE)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    summed = answers.repartition(buckets, "chunk").sortWithinPartitions("chunk", F.col("kind").desc()).mapInArrow(add_up, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    final = F.col("score") if total else F.col("base_score")
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", final.alias("score"))
