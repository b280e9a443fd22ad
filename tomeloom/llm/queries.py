"""The operators over the standard tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fmindex, icws, katz, langid, lattice, mainhtml, mixing, resampling, rules, secrets, shards, toxicity
from .base import read, spread


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; a source's documents of one language are a repository."""
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return secrets.digest(secrets.scan_owned(docs, F.col("source"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shard(shards.sized(read(spark, sf_dir, "documents", "doc_id", "text"))))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return langid.predict(docs, langid.train(langid.sample_pieces(docs)))


def op4_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.digest(spread(read(spark, sf_dir, "documents", "doc_id", "text")))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spread(read(spark, sf_dir, "documents", "doc_id", "text")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    return rules.digest(docs, rules.learn(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(spread(read(spark, sf_dir, "pages", "page_id", "url", "html")))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(spread(read(spark, sf_dir, "documents", "doc_id", "text")), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(mixing.sized(read(spark, sf_dir, "documents", "doc_id", "text", "source"))))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    return resampling.digest(resampling.resample(docs, read(spark, sf_dir, "benchmark", "text")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(spread(read(spark, sf_dir, "documents", "doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_secrets, op2_shards, op3_language, op4_near_text, op5_katz, op6_quality, op7_main_text, op8_near_vectors, op9_decontaminate, op10_mixing, op11_resampling, op12_toxicity, op13_alignment)
    }
