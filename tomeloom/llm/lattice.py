"""Near-duplicate vectors by E8 lattice hashing.

Equal vectors of one label are taken once. The rest are projected at random, several times, to
one or more blocks of eight dimensions, and each block is decoded to the nearest point of the E8
lattice: the points together are the vector's bucket in that table. Each vector also probes
neighbouring cells (of the 240 around each point) whose walls it is nearest to. Vectors that meet
in a cell are candidates; cosine in double precision decides.

Cells multiply with the vectors: the blocks of a table and the stretch of the last one follow from
the size of the largest label, so that a vector meets about as many strangers in a large table as
in a small one. More blocks part near vectors more often, so tables and probes grow with them. No
bucket is capped.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, those
without a label and those without an id link with nothing and are their own component (null for a
null id); vectors of different length never link; rows of one vec_id share a component id, and the
largest number of links that one of them has; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, mix
from .components import components

COSINE = 0.98
#: Tables for cells of one block, and how many more for each further block.
TABLES, MORE_TABLES = 4, 2
#: Neighbouring cells that each vector probes in each table for one block, and how many more for each further block.
PROBES, MORE_PROBES = 8, 4
#: Cells that unit vectors, projected to eight dimensions, fall into, about: one over the chance that two strangers share one.
CELLS = 14_000
#: Vectors of a label for which one block's cells are enough.
ENOUGH = 4_000


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    if len(odd):
        off = y[odd] - f[odd]
        worst = np.abs(off).argmax(1)
        at = np.arange(len(odd))
        f[odd, worst] += np.where(off[at, worst] >= 0, 1, -1)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, to each row."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    """A hash of each row of lattice coordinates."""
    h = np.full(len(points), table + 1, dtype=np.uint64)
    for k in range(points.shape[1]):
        h = mix(h ^ (points[:, k] * 2).astype(np.int64).view(np.uint64), k + 1)
    return h.view(np.int64)


def stretches(vectors: int) -> list[float]:
    """The stretch of each block of a table: a block of stretch s has CELLS * s**8 cells, and all together grow with the vectors."""
    factor, out = max(vectors / ENOUGH, 1.0), [1.0]
    while factor > 1.05:
        out.append(min(1.0, (factor / CELLS) ** 0.125))
        factor /= CELLS
    return out


def effort(blocks: int) -> tuple[int, int]:
    """Tables, and probes in each, for cells of so many blocks."""
    return TABLES + MORE_TABLES * (blocks - 1), PROBES + MORE_PROBES * (blocks - 1)


def cells(x: np.ndarray, blocks: list[float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each table: its number, home cells (n), probed cells (n, probes) of the unit rows of x."""
    neighbours, m = minimal_vectors(), len(blocks)
    tables, probes = effort(m)
    for t in range(tables):
        homes, walls, steps = [], [], []
        for b, stretch in enumerate(blocks):
            rng = np.random.default_rng([1000 + t, b])
            y = x @ rng.normal(size=(x.shape[1], 8)) * stretch + rng.random(8)
            home = decode(y)
            # A cell's wall toward home + v lies where (y - home) . v = |v|^2 / 2, and all |v|^2 are 2.
            reach = (1 - (y - home) @ neighbours.T) / stretch
            near = np.argsort(reach, axis=1, kind="stable")[:, :probes]
            homes.append(home)
            walls.append(np.take_along_axis(reach, near, axis=1))
            steps.append(neighbours[near])
        # One wall crossed, or one wall of each of two blocks: the nearest of them all.
        moves = [((b, k),) for b in range(m) for k in range(probes)] + [((b, k), (c, j)) for b in range(m) for c in range(b) for k in range(probes) for j in range(probes)]
        cost = np.stack([sum(walls[b][:, k] for b, k in move) for move in moves], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        point = np.concatenate(homes, axis=1)
        shift = np.zeros((len(moves), len(x), 8 * m), dtype=np.float32) if len(x) else np.zeros((len(moves), 0, 8 * m), dtype=np.float32)
        for i, move in enumerate(moves):
            for b, k in move:
                shift[i, :, 8 * b : 8 * b + 8] += steps[b][:, k]
        around = point[:, None] + shift[best, np.arange(len(x))[:, None]]
        yield t, _cell(point, t), _cell(around.reshape(-1, 8 * m), t).reshape(len(x), probes)


def _unit(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows of a list column (no nulls inside, ``size`` components each) as unit vectors."""
    values, begin = column.values.to_numpy(), column.offsets.to_numpy()[rows]
    x = values[begin[:, None] + np.arange(size)].astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _keys(vectors: DataFrame, blocks: list[float]) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("rep").to_numpy(), batch.column("label").to_numpy()
            sizes = _sizes(batch.column("embedding"))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for t, home, around in cells(_unit(batch.column("embedding"), rows, size), blocks):
                    cell = np.concatenate([home[:, None], around], axis=1)
                    n = cell.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[rows], n)),
                            pa.array(np.repeat(labels[rows], n)),
                            pa.array(np.full(len(rows) * n, t, dtype=np.int32)),
                            pa.array(cell.ravel() ^ np.int64(size)),
                            pa.array(np.tile(np.arange(n) == 0, len(rows))),
                        ],
                        ["rep", "label", "hash_table", "cell", "home"],
                    )

    return vectors.mapInArrow(apply, "rep long, label long, hash_table int, cell long, home boolean")


def _verified(pairs: DataFrame) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            sizes = _sizes(u)
            linked = np.zeros(len(batch), dtype=bool)
            for size in np.unique(sizes):
                rows = np.flatnonzero((sizes == size) & (_sizes(v) == size))
                linked[rows] = (_unit(u, rows, size) * _unit(v, rows, size)).sum(1) >= COSINE
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(linked)), batch.column("b").filter(pa.array(linked))], ["a", "b"])

    return pairs.mapInArrow(apply, "a long, b long")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label (long) of the vectors that can link."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False))).select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


def link(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership: vec_id, rep; links: a, b, each pair of representatives once, a < b).

    A representative is named by the least vec_id among its equal vectors; links within a group
    of equal vectors are not listed.
    """
    good = usable(vectors).where(F.col("vec_id").isNotNull())
    groups = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    largest = groups.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    keys = cut(_keys(groups.select("rep", "label", "embedding"), stretches(largest)))
    on = ["label", "hash_table", "cell"]
    met = keys.select(F.col("rep").alias("p"), *on).join(keys.where("home").select(F.col("rep").alias("q"), *on), on).where("p <> q")
    pairs = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    store = groups.select("rep", "embedding")
    full = pairs.join(store.select(F.col("rep").alias("a"), F.col("embedding").alias("u")), "a").join(store.select(F.col("rep").alias("b"), F.col("embedding").alias("v")), "b")
    return groups.select("rep", "n", "label", "embedding"), cut(_verified(full.select("a", "b", "u", "v")))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    groups, links = link(vectors)
    size = groups.select("rep", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(links)
    named = (
        groups.join(linked, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    named = cut(named)
    good = usable(vectors).where(F.col("vec_id").isNotNull())
    found = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    per_id = found.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select("vec_id").join(per_id, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
