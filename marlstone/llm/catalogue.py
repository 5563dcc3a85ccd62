"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ann, fingerprints, licenses, mixing, neardup, packing, pii, quality, secret_scan, toxicity
from marlstone.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    return packing.pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_mixing"] = mixing.SQL


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text."""
    return fingerprints.fingerprint_digest(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, from its text and from its host and path."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to every fiftieth."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
