"""A corpus pipeline: quality, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of docs.

Defined results, for every stage: a null text counts as the empty one and stays null where the row
stays; null and repeated ids are rows like any other; columns that a stage doesn't know are carried
along under whatever name; texts of any length are read whole; an empty table gives an empty one.
quality scores empty and null texts by their statistics, all 0, and so rejects or keeps them all;
near_duplicates keeps every row without words, and of repeated rows one; decontaminate keeps them,
too, and drops only texts that consist of benchmark passages; mix_sources treats a row without
words as one of size 0, taken with those beside it in the queue, and repeats rows as rows; shard places every row, repeated ones by slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeloom.llm import fmindex, icws, mixing, rules, shards
from tomeloom.llm.base import cut, read, shared_folder

#: Columns that the stages work on; all others are carried along.
NAMED = ("doc_id", "text", "source", "n_chars")


def _shielded(docs: DataFrame) -> DataFrame:
    """docs with columns that no stage knows renamed, so that they can't clash with a stage's own."""
    return docs.toDF(*[c if c in NAMED else f"carried_{i}" for i, c in enumerate(docs.columns)])


def _restored(rows: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    names = _shielded(docs).columns
    return rows.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)], *more)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row; written once, as a second reading may pack and number the rows otherwise."""
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble predicts to be of quality."""
    model = rules.learn(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return _restored(rules.score(_shielded(docs), model).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return _restored(icws.drop_near_duplicates(_shielded(docs)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a text of nothing else goes."""
    return _restored(fmindex.remove(_shielded(docs), read(spark, sf_dir, "benchmark", "item_id", "text")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; what it doesn't take goes."""
    rows = _numbered(_shielded(docs))
    sizes = mixing.sized(rows, "_row")
    passes = mixing.mix(sizes).where("passes > 0").select("_row", "passes")
    taken = rows.join(passes, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    return _restored(taken, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    rows = _numbered(_shielded(docs))
    placed = shards.shard(shards.sized(rows, "_row"), order=("text_crc32", "size", "doc_id", "_row")).select("_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = rows.join(placed, "_row")
    out = _restored(joined, docs, "_shard", "_slot")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*names, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The fitted and sampled stages can't be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    at = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
