from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tomeloom.llm import fmindex, mixing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("mine"), "_row": F.lit(7), "shard": F.lit("old")})
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = docs.collect()
        if name != "shard":
            assert docs.columns == before.columns
        assert {r.score for r in rows[name]} == {"mine"}
    assert len({r.doc_id for r in rows["near_duplicates"]}) == len(rows["near_duplicates"]) <= len(rows["quality"])
    clean = spark.createDataFrame(rows["decontaminate"]).select("doc_id", "text")
    assert fmindex.digest(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    mixed = Counter(r.doc_id for r in rows["mix_sources"])
    assert max(mixed.values()) <= 3 and {*mixed} <= {r.doc_id for r in rows["decontaminate"]}
    slots = Counter((r.shard, r.slot) for r in rows["shard"])
    assert len(rows["shard"]) == sum(mixed.values()) and max(slots.values()) == 1
    size = Counter()
    for r in rows["shard"]:
        size[r.shard] += len((r.text or "").encode()) + 1
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 2 * max(len((r.text or "").encode()) + 1 for r in rows["shard"])


def test_numbers_hold_when_a_second_reading_packs_rows_otherwise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def anyhow(batches):
        rng = np.random.default_rng()  # another order at each reading
        for batch in batches:
            yield batch.take(pa.array(rng.permutation(len(batch))))

    unsteady = docs.mapInArrow(anyhow, docs.schema)
    placed = corpus_pipeline.shard(spark, unsteady, SF).collect()
    assert [r.doc_id for r in sorted(placed, key=lambda r: (r.shard, r.slot))] == [r.doc_id for r in sorted(docs.collect(), key=lambda r: (zlib.crc32((r.text or '').encode()), len((r.text or '').encode()), r.doc_id))]
    passes = {r.doc_id: r.passes for r in mixing.digest(mixing.mix(mixing.sized(docs))).collect() if r.passes}
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, unsteady, SF).collect()) == passes


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.where("length(text) between 500 and 900").orderBy("doc_id").limit(6).collect()
    rows = [tuple(r) for r in plain] + [tuple(plain[0])] + [(None, plain[1].text, "en", None, 1), (plain[2].doc_id, plain[3].text + " and more of it", "en", "s", 1)]
    odd = [(9001, None, None, None, None), (None, None, None, None, None), (9002, "", "en", "s", 0), (9002, " \n\t", "en", "s", 3), (9003, "word " * 300_000, "en", "t", 1_500_000)]
    kept = spark.createDataFrame(rows + odd, docs.schema)
    count = {}
    for name in ("near_duplicates", "decontaminate", "mix_sources", "shard"):
        stage = dict(corpus_pipeline.STAGES)[name]
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        count[name] = Counter((r.doc_id, None if r.text is None else len(r.text)) for r in kept.collect())
    near = count["near_duplicates"]
    assert near[9001, None] == near[None, None] == near[9002, 0] == near[9002, 3] == 1
    assert sum(near.values()) == 6 + 5  # a copy, one under no id, and one with a few words more go
    assert count["decontaminate"] == near
    mixed = count["mix_sources"]
    assert set(mixed) <= set(near) and max(mixed.values()) <= 3 and (9003, 1_500_000) in near
    assert count["shard"] == mixed
    given = spark.createDataFrame(rows + odd, docs.schema)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality(spark, given, SF).collect())
    empty = [kept[r.doc_id, r.text] for r in given.where("coalesce(text, '') = ''").collect()]
    assert len(set(empty)) == 1 and not kept - Counter((r.doc_id, r.text) for r in given.collect())
