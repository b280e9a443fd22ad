from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeloom.llm import base, queries, regular, resampling

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "the cat sat on the mat and the dog " * 4), (None, "the cat sat on the mat and the dog " * 4), (3, " \n\t "), (4, "x" * 200_000 + " y" * 30), (5, "The OF and to Ünïcode ßtraße " * 900), (6, "same text here for all of them " * 5), (6, "same text here for all of them " * 5), (7, "same text here for all of them " * 5)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def runs_of(text, grams):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + g]).encode()) % resampling.BUCKETS for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute(docs, target, grams=1, percent=10, least=20):
    found = [runs_of(t, grams) for _, t in docs]
    corpus, wanted = Counter(b for _, r in found for b in r), Counter(b for t in target for b in runs_of(t, grams)[1])
    s, t = sum(corpus.values()) + resampling.BUCKETS, sum(wanted.values()) + resampling.BUCKETS
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s / ((corpus[b] + 1) * t))) for b in corpus}
    out = []
    for (i, _), (n, r) in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in r) // len(r) if r else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(eligible[: len(eligible) * percent // 100], 1):
        r[5] = k
    return sorted(map(repr, out))


@pytest.mark.parametrize(("grams", "percent"), [(1, 10), (3, 50), (2, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, monkeypatch, grams, percent):
    docs = base.read(spark, SF, "documents", "doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(5)
    target = base.read(spark, SF, "benchmark", "text").unionByName(spark.createDataFrame([(None,), ("",)], "text string"))
    expected = brute([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], grams, percent)
    for rows in (1 << 20, 20):  # four segments, then a dozen
        monkeypatch.setattr(regular, "SEGMENT_ROWS", rows)
        got = resampling.resample(docs, target, percent=percent, grams=grams).collect()
        assert sorted(repr([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in got) == expected


def test_resampling_without_target_or_documents(spark):
    docs, none = base.read(spark, SF, "documents", "doc_id", "text"), spark.createDataFrame([], "text string")
    assert sorted(repr([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in resampling.resample(docs, none).collect()) == brute([tuple(r) for r in docs.collect()], [])
    assert resampling.resample(docs.where("false"), none).count() == 0


def test_states_of_words_equal_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.choice([0, 1, 2, 7, 30, 47, 48, 49, 200, 900], 300)
    state = np.full(300, 0xFFFFFFFF, dtype=np.uint32)
    got = resampling.crc_states(data, start, end, state) ^ np.uint32(0xFFFFFFFF)
    assert [int(x) for x in got] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_ranks_by_regular_sampling(spark, monkeypatch):
    """A key that a third of all rows hold, keys in order and in reverse, and the balance of the segments."""
    monkeypatch.setattr(regular, "SEGMENT_ROWS", 1000)
    n = 20_000
    keys = [F.lit(7), F.col("id"), -F.col("id")]
    rows = spark.range(0, n, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("long").alias("a"), *[k.cast("long").alias(f"b{i}") for i, k in enumerate(keys)], "id")
    for order in (["a", "b1"], ["b0", "b2"], ["a"]):
        got = regular.ranked(rows, order).select(*order, "id", "rank", F.spark_partition_id().alias("p")).collect()
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, n + 1))
        values = [tuple(r[k] for k in order) for r in got]
        assert values == sorted(values) and len({r.id for r in got}) == n
        held = Counter(r.p for r in got)
        assert len(held) == 20 and max(held.values()) <= n / 20 * (1 + 6 / regular.SAMPLES) + 6
    few = regular.ranked(rows, ["b1"], lambda runs: 17).where("rank is not null").orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in few] == [(i + 1, i) for i in range(17)]


def test_query_returns_every_document(spark):
    got = queries.queries()["op11_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert got.count() == base.read(spark, SF, "documents").count()
