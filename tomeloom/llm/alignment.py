"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Each text is encoded by a byte-level BPE (A) and a piece model (B). Tokens cover the same bytes, so
both give rising lists of end offsets; texts are laid behind one another, so that a run of texts is
one pair of lists. Merging the two is divided by diagonals: for every PIECE steps of the merge a
binary search finds how many ends of either side lie before it. Pieces of equal work follow,
however long a text is; each finds the ends that its two parts share without looking at any other,
and what meets across a border of two pieces is stitched on. Shared ends cut a text into groups and
link the two tokens that end there.

How often an id pair is linked is counted over the corpus: tasks add up their own links before the
counts are shuffled. Links whose pair makes up SHARE of all links or more (1 / SHARE pairs at most)
are looked up in a broadcast table, all others by a join on the pair, of which none is frequent.

Defined results: null and empty texts, and texts whose tokens don't give back the space and the
text (as where a text holds U+2581), have no tokens: all counts are 0 and groups_sha256 is ''; rows
of one id and equal rows each count and get a row; an empty table gives an empty result. A text is
encoded as a whole, so one of n bytes takes some 100 * n bytes of its task's memory.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

#: Steps of the merge in one piece.
PIECE = 1 << 16
#: Bytes of text that are encoded and aligned together (a longer text alone).
RUN_BYTES = 1 << 18
#: Pairs that make up this share of all links are broadcast.
SHARE = 1e-6
#: Distinct pairs that a task adds up before it passes them on, and links that it takes at a time.
HELD_PAIRS, RUN_LINKS = 1 << 20, 1 << 19
#: Folder of the public vocabularies, and the two that the query takes.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Encoder:
    """ids of texts, and the bytes of each id."""

    def __init__(self, entries: list[bytes], encode):
        self.entries, self.encode = entries, encode
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)


#: Fixed value: the pattern by which byte-level vocabularies of this kind split a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def byte_level(model: bytes) -> Encoder:
    """A byte-level BPE as a JSON file; a space goes before each text, and special tokens' strings are plain text.

    Where the ids are the ranks of the merges and the usual pattern splits the text, as in the
    vocabularies of this kind, an encoder by ranks gives the same ids in a quarter of the time.
    """
    parts, of = json.loads(model), byte_characters()
    special = {t["content"] for t in parts["added_tokens"]}
    vocabulary = parts["model"]["vocab"]
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, i in ranks.items():
        entries[i] = token
    merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
    split = parts["pre_tokenizer"]
    plain = parts["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    if plain and all(vocabulary[a + b] == 256 + k for k, (a, b) in enumerate(merges)):
        import tiktoken

        by_rank = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Encoder(entries, lambda texts: [by_rank.encode_ordinary(" " + t) for t in texts])
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.encode_special_tokens = True
    return Encoder(entries, lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])


@functools.lru_cache(maxsize=2)
def piece_model(model: bytes) -> Encoder:
    """A piece model; it puts the space before each text itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    entries = []
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        entries.append(b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode())
    return Encoder(entries, lambda texts: p.encode(texts, num_threads=1))


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b lie before each piece of the merge, and in all; of equals a's comes first."""
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        before = a[middle] <= b[d[open_] - 1 - middle]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low, d - low


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all a[i] = b[j], for rising a and b."""
    at_a, at_b = diagonals(a, b, piece or PIECE)
    found = []
    for i0, i1, j0, j1 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True):
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:  # a's end fell to the piece before: stitched here
            found.append((np.array([i0 - 1]), np.array([j0])))
        x, y = a[i0:i1], b[j0:j1]
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            hit = np.flatnonzero(y[np.minimum(at, len(y) - 1)] == x)
            found.append((i0 + hit, j0 + at[hit]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Run:
    """The tokens of a run of texts and where they end together.

    a, b: ids; of_a, of_b: where each text's tokens begin, then the end; i, j: tokens that end
    together; cuts: where each text's links begin, then the end; ends: a's end offsets in the run.
    """

    def __init__(self, texts: list[str], left: Encoder, right: Encoder):
        some = [k for k, t in enumerate(texts) if t]
        ids: list[list] = [[[] for _ in texts] for _ in range(2)]
        for side, encoder in enumerate((left, right)):
            for k, found in zip(some, encoder.encode([texts[k] for k in some]), strict=True):
                ids[side][k] = found
        for k in some:
            whole = b" " + texts[k].encode()
            if any(b"".join([e.entries[i] for i in x[k]]) != whole for e, x in ((left, ids[0]), (right, ids[1]))):
                ids[0][k], ids[1][k] = [], []
        (self.a, self.of_a, self.ends), (self.b, self.of_b, ends) = (self._laid(x, e) for x, e in zip(ids, (left, right), strict=True))
        self.i, self.j = shared_ends(self.ends, ends)
        self.cuts = np.searchsorted(self.i, self.of_a)

    @staticmethod
    def _laid(ids: list[list[int]], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([np.array(x, dtype=np.int64) for x in ids])
        return flat, np.cumsum([0, *map(len, ids)]), np.cumsum(encoder.lengths[flat])

    def pairs(self) -> np.ndarray:
        """The id pair of each link as one number."""
        return self.a[self.i] << 32 | self.b[self.j]

    def listed(self) -> list[bytes]:
        """For each text its groups as decimal ids: a1,a2|b1;a3|b2,b3."""
        n, m = len(self.a), len(self.b)
        if not n:
            return [b""] * (len(self.of_a) - 1)
        last_a, last_b = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
        last_a[self.i], last_b[self.j] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # A token stands behind the others of its side, and behind the other side's groups before it.
        place_a = np.arange(n) + np.concatenate([[0], self.j + 1])[group_a]
        place_b = np.arange(m) + (self.i + 1)[group_b]
        ids, mark = np.empty(n + m, dtype=np.int64), np.empty(n + m, dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a] = np.where(last_a, ord("|"), ord(","))
        mark[place_b] = np.where(last_b, ord(";"), ord(","))
        digits = np.searchsorted(10 ** np.arange(1, 19), ids, side="right") + 1
        stop = np.cumsum(digits + 1)
        out = np.empty(int(stop[-1]), dtype=np.uint8)
        out[stop - 1] = mark
        for k in range(int(digits.max())):
            some = digits > k
            out[stop[some] - 2 - k] = ids[some] // 10**k % 10 + ord("0")
        edge = np.concatenate([[0], stop])[self.of_a + self.of_b]
        return [out[s : max(s, e - 1)].tobytes() for s, e in zip(edge[:-1], edge[1:], strict=True)]


def _runs(column: pa.Array, left: Encoder, right: Encoder) -> Iterator[tuple[int, int, Run]]:
    texts = column.to_pylist()
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= RUN_BYTES):
            size += len(texts[stop] or "")
            stop += 1
        yield at, stop, Run(texts[at:stop], left, right)
        at = stop


def _models(spark, folder: str | None) -> tuple:
    """Both vocabulary files as broadcast values (executors needn't have them), and the bits that a B id takes in a packed pair."""
    out = []
    for name in (BYTE_LEVEL, PIECES):
        with open(f"{folder or FOLDER}/{name}", "rb") as f:
            out.append(f.read())
    few = all(len(e.entries) <= 1 << 16 for e in (byte_level(out[0]), piece_model(out[1])))
    return *map(spark.sparkContext.broadcast, out), 16 if few else 32


def _packed(pairs: np.ndarray, bits: int) -> np.ndarray:
    return pairs if bits == 32 else ((pairs >> 32 << 16) | (pairs & 0xFFFF)).astype(np.uint32)


def groups(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and groups of docs (doc_id, text): for each group its byte span in space + text and the ids of both sides."""
    rows = docs.select("doc_id", "text")
    a, b, _ = _models(docs.sparkSession, folder)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(a.value), piece_model(b.value)
        for batch in batches:
            for i, j, run in _runs(batch.column("text"), left, right):
                stops = run.ends[run.i]
                starts = np.concatenate([[0], stops])[:-1]
                first = np.repeat(starts[np.minimum(run.cuts[:-1], max(len(starts) - 1, 0))] if len(starts) else run.cuts[:-1], np.diff(run.cuts))
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], at + 1]).astype(np.int32), pa.array(ids.astype(np.int32))) for at, ids in ((run.i, run.a), (run.j, run.b))]
                one = pa.StructArray.from_arrays([pa.array(starts - first), pa.array(stops - first), *lists], ["start", "stop", "a", "b"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(run.cuts.astype(np.int32), one)], ["doc_id", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, groups array<struct<start:long,stop:long,a:array<int>,b:array<int>>>")


def align(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, bits and links of docs (doc_id, text).

    links: the id pair of each link, in order, as numbers a << bits | b of twice the bits, least byte
    first; bits: 16 if neither vocabulary has more ids, else 32.
    """
    rows = docs.select("doc_id", "text")
    a, b, bits = _models(docs.sparkSession, folder)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(a.value), piece_model(b.value)
        for batch in batches:
            for i, j, run in _runs(batch.column("text"), left, right):
                pairs, n = _packed(run.pairs(), bits), np.diff(run.cuts)
                shas = [hashlib.sha256(x).hexdigest() if x else "" for x in run.listed()]
                links = pa.array([pairs[s:e].tobytes() for s, e in zip(run.cuts[:-1], run.cuts[1:], strict=True)], pa.binary())
                numbers = [pa.array(x.astype(np.int64)) for x in (np.diff(run.of_a), np.diff(run.of_b), n, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *numbers, pa.array(shas, pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(apply, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")
    return out.withColumn("bits", F.lit(bits))


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, pairs as a << 32 | b, row of each from the first) of a batch, about RUN_LINKS links at a time."""
    links = batch.column("links").to_pylist()
    narrow = len(links) > 0 and batch.column("bits")[0].as_py() == 16
    sizes = np.array([len(x) // (4 if narrow else 8) for x in links], dtype=np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(links):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + RUN_LINKS, side="right")))
        pairs = np.frombuffer(b"".join(links[at:stop]), dtype=np.uint32 if narrow else np.int64).astype(np.int64)
        yield at, stop, (pairs >> 16 << 32) | (pairs & 0xFFFF) if narrow else pairs, np.repeat(np.arange(stop - at), sizes[at:stop])
        at = stop


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n and best of every id pair linked in aligned (links, bits): how often, and whether no pair of its B id is linked more often."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])

        for batch in batches:
            for _, _, pairs, _ in _pairs_of(batch):
                kinds, n = np.unique(pairs, return_counts=True)
                both, at = np.unique(np.concatenate([held[0], kinds]), return_inverse=True)
                held = both, np.bincount(at, weights=np.concatenate([held[1], n]), minlength=len(both)).astype(np.int64)
                if len(both) > HELD_PAIRS:
                    yield out()
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    counts = cut(aligned.select("links", "bits").mapInArrow(apply, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    best = counts.withColumn("_b", b).join(F.broadcast(most), "_b")  # a row for each id of B's vocabulary at most
    return best.select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of docs (doc_id, text)."""
    aligned = cut(align(docs, folder).withColumn("_row", F.monotonically_increasing_id()))
    pairs = cut(pair_counts(aligned))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = pairs.where(F.col("n") >= max(1, total * SHARE)).orderBy("pair").toArrow()  # 1 / SHARE rows at most
    table = docs.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("pair", "n", "best")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for batch in batches:
            numbers = batch.column("_row").to_numpy()
            for i, j, pairs, row in _pairs_of(batch):
                rows, zeros = numbers[i:j], np.zeros(j - i, np.int64)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                n_best, total = (np.bincount(row[hit], weights=x[at[hit]], minlength=j - i).astype(np.int64) for x in (best, counts)) if hit.any() else (zeros, zeros)
                order = np.lexsort((pairs[~hit], row[~hit]))
                rare, of = pairs[~hit][order], row[~hit][order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times, none = np.diff(np.append(first, len(rare))), np.zeros(len(first), np.int64)
                # A text's own row gets a number of its own in place of a pair, so that these rows don't meet in one task.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ((rows, rows[of[first]]), (-1 - rows, rare[first]), (zeros, times), (n_best, none), (total, none))],
                    ["_row", "pair", "times", "n_best", "count_sum"],
                )

    looked_up = aligned.select("_row", "links", "bits").mapInArrow(apply, "_row long, pair long, times long, n_best long, count_sum long")
    both = looked_up.join(pairs.where(F.col("n") < max(1, total * SHARE)), "pair", "left")
    n_best = F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)
    sums = both.groupBy("_row").agg(F.sum(n_best).alias("n_best"), F.sum(F.col("count_sum") + F.col("times") * F.coalesce("n", F.lit(0))).alias("count_sum"))
    return aligned.drop("links", "bits").join(sums, "_row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
