"""Windows of claims against a plain reading, cut at several places, and a long text asked by many claims."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tomeloom.operators import audit


def plain(text, claim):
    bare = lambda x: "".join(c for c in x if c not in audit.T.WHITE)
    grams = {a + b for a, b in zip(bare(claim), bare(claim)[1:])}
    starts = range(0, max(-(-len(text) // 800) - 1, 1) * 800, 800) if text else []
    scored = [(-sum(g in bare(text[s : s + 1600]) for g in grams) / max(1, len(grams)), s) for s in starts]
    return [(k + 1, s, round(-x, 9)) for k, (x, s) in enumerate(sorted(scored)[:5])]


@pytest.mark.parametrize("cut", [False, True])
def test_windows_equal_a_plain_reading(spark, monkeypatch, cut):
    if cut:  # few windows, characters and claims at a time
        for name, value in (("WINDOWS", 2), ("CHARS", 1500), ("TOGETHER", 2)):
            monkeypatch.setattr(audit, name, value)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \n　\x85\U0001f600中́") for _ in range(n))
    sizes = [0, 1, 2, 799, 800, 801, 1600, 1601, 2400, 7777, *(rng.randint(0, 6000) for _ in range(20))]
    texts = {i: text(n) for i, n in enumerate(sizes)} | {90: " " * 3000, 91: "a" + " " * 2500 + "b"}
    claims = [(f"{i}-{k}", i, rng.choice([text(rng.randint(0, 40)), t[k * 300 : k * 300 + 30], "", "x", "ab"])) for i, t in texts.items() for k in range(rng.randint(0, 7))]
    claims += [("90", 90, "ab"), ("91", 91, "ab"), ("no source", 99, "abc")]
    asked = spark.createDataFrame(claims, "claim_id string, source_id long, claim string")
    sources = spark.createDataFrame(list(texts.items()), "source_id long, text string")
    got = {}
    for r in audit.best_windows(asked, sources).orderBy("claim_id", "rank").collect():
        got.setdefault(r.claim_id, []).append((r.rank, r.start, round(r.score, 9)))
    expected = {c: plain(texts.get(i, ""), x) for c, i, x in claims}
    assert got == {c: x for c, x in expected.items() if x}


def test_a_long_text_asked_by_many_claims(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(190_000))
    asked = spark.createDataFrame([(k, text[k * 12_000 : k * 12_000 + 200], 1) for k in range(90)], "claim_id long, claim string, source_id long")
    sources = spark.createDataFrame([(1, text)], "source_id long, text string")
    assert len(text) > audit.WINDOWS * audit.STRIDE
    began = time.time()
    first = {r.claim_id: r for r in audit.best_windows(asked, sources).where("rank = 1").collect()}
    assert time.time() - began < 20
    assert len(first) == 90 and all(first[k].score == 1 and first[k].start <= k * 12_000 + 200 for k in range(90))


def test_claims_are_listed_once(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("book_id"), F.lit(0).alias("chapter_index"), F.lit("A sentence of some length; another one of it.").alias("text")).write.parquet(str(tmp_path / "c"))
    plan = audit.picked(spark.read.parquet(str(tmp_path / "c")), "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1
