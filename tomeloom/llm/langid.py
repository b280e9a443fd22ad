"""Language by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter
keeps its maximum, and a softmax layer reads the maxima. Training takes a bounded sample of
labelled rows. To apply it, embedding and filters are folded into tables over byte pairs, so a
filter's response is a sum of a few table rows; a text's windows are weighed by their bytes and
their logits averaged, so whole texts count.

Defined results: a null text or one without letters is ``und`` with score 0; rows whose language
is null are predicted but not learned from; without any labelled row all texts are ``und``;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out, text_runs

FOLD = (3, 1)
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled rows that training takes for each language at most (in expectation, by a hash of the id).
PER_LANGUAGE = 400
PIECES = 4
#: Windows that are evaluated together.
BATCH = 512


class ByteConvNet:
    """weights: embedding (256, E); per width w a filter bank (w, E, F) and bias; dense (3F, C) and bias."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.banks = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), dtype=np.float32)

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 6) -> None:
        """Adam on the cross entropy; gradients flow through each filter's maximal position only."""
        rng = np.random.default_rng(seed)
        parameters = [self.embedding, *self.banks, *self.biases, self.dense, self.offset]
        first = [np.zeros_like(p) for p in parameters]
        second = [np.zeros_like(p) for p in parameters]
        steps, k = 0, len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                x, n = windows[rows], len(rows)
                e = self.embedding[x]
                pooled, chosen = [], []
                for w, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
                    length = WINDOW - w + 1
                    z = sum(e[:, j : j + length] @ bank[j] for j in range(w)) + bias
                    best = z.argmax(axis=1)
                    pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
                    chosen.append(best)
                h = np.concatenate(pooled, axis=1)
                a = np.maximum(h, 0)
                logits = a @ self.dense + self.offset
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                g_embedding = np.zeros_like(self.embedding)
                g_banks, g_biases = [], []
                for i, (w, bank) in enumerate(zip(WIDTHS, self.banks, strict=True)):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    at_byte = x[np.arange(n)[:, None, None], chosen[i][:, :, None] + np.arange(w)]
                    g_banks.append(np.einsum("nf,nfwe->wef", g, self.embedding[at_byte]))
                    g_biases.append(g.sum(0))
                    np.add.at(g_embedding, at_byte, np.einsum("nf,wef->nfwe", g, bank))
                steps += 1
                for j, (value, grad) in enumerate(zip(parameters, [g_embedding, *g_banks, *g_biases, a.T @ p, p.sum(0)], strict=True)):
                    first[j] = 0.9 * first[j] + 0.1 * grad
                    second[j] = 0.999 * second[j] + 0.001 * grad**2
                    value -= rate * (first[j] / (1 - 0.9**steps)) / (np.sqrt(second[j] / (1 - 0.999**steps)) + 1e-8)
        self.banks, self.biases = parameters[1 : 1 + k], parameters[1 + k : 1 + 2 * k]

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width: (shift, over pairs?, table), whose looked-up rows sum to the filters' responses."""
        out = []
        for w, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
            single = [self.embedding @ bank[j] for j in range(w)]
            single[0] = single[0] + bias
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, single[w - 1]))
            out.append(parts)
        return out


def fill_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, WINDOW) bytes; what lies beyond a window's length is 0."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < lengths[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8)


def window_logits(net: ByteConvNet, tables: list, windows: np.ndarray) -> np.ndarray:
    x = windows.astype(np.intp)
    pairs = x[:, :-1] * 256 + x[:, 1:]
    pooled = []
    for w, parts in zip(WIDTHS, tables, strict=True):
        length = WINDOW - w + 1
        z = None
        for shift, paired, table in parts:
            got = np.take(table, (pairs if paired else x)[:, shift : shift + length], axis=0)
            z = got if z is None else np.add(z, got, out=z)
        pooled.append(z.max(axis=1))
    return np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.offset


def sample_pieces(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, piece of text) for training: a hash of the id chooses about PER_LANGUAGE rows of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", *FOLD))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    scale = 1 << 30
    wanted = None
    for lang, n in sorted(counts.items()):
        share = int(scale * min(1.0, PER_LANGUAGE / n))
        wanted = F.when(F.col("lang") == lang, share) if wanted is None else wanted.when(F.col("lang") == lang, share)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < wanted)
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    pieces = [F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(PIECES)]
    return [(r["lang"], p) for r in chosen.select("doc_id", "lang", F.array(*pieces).alias("pieces")).orderBy("doc_id").collect() for p in r["pieces"]]


def train(pieces: list[tuple[str, str]], seed: int = 4) -> ByteConvNet | None:
    """Whole windows and, for short texts, pieces cut to 12 to 100 bytes."""
    if not pieces:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in pieces})
    net = ByteConvNet(languages)
    windows, y = [], []
    for i, (lang, piece) in enumerate(pieces):
        data = np.frombuffer(piece.lower().encode(), dtype=np.uint8)[:WINDOW]
        if i % 3 == 0 and len(data) > 12:
            size = int(rng.integers(12, 100))
            at = int(rng.integers(0, max(1, len(data) - size)))
            data = data[at : at + size]
        windows.append(fill_windows(data if len(data) else np.zeros(1, np.uint8), np.array([0]), np.array([len(data)]))[0])
        y.append(languages.index(lang))
    net.train(np.stack(windows), np.array(y))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", held_out("doc_id", *FOLD).alias("held_out"), F.lower("text").alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = net.tables(), np.array([*net.languages, "und"], dtype=object)
        for batch in batches:
            column = batch.column("text")
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            for i, j, data, offsets in text_runs(column):
                sizes = np.diff(offsets)
                counts = -(-sizes // WINDOW)
                doc = np.repeat(np.arange(j - i), counts)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = offsets[:-1][doc] + place * WINDOW
                lengths = np.minimum(WINDOW, offsets[1:][doc] - starts)
                logits = np.zeros((j - i, len(names) - 1))
                for at in range(0, len(doc), BATCH):
                    part = slice(at, at + BATCH)
                    got = window_logits(net, tables, fill_windows(data, starts[part], lengths[part]))
                    np.add.at(logits, doc[part], got * lengths[part][:, None])
                logits /= np.maximum(sizes, 1)[:, None]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[i:j], score[i:j] = p.argmax(1), p.max(1)
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], dtype=bool)  # Unicode's letters, not its other numbers
            best[~lettered], score[~lettered] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
