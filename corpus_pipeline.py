"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the next stage's docs. All but the last return
the columns of documents, and any further ones, as they are but for masked texts.

Odd inputs: an empty table gives empty tables; texts of any length are handled whole; rows
without doc_id or source are rows like others (a null source is a source of its own, ranked
last). What each stage does with null or empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import mixing, neardup, packing, quality, secret_scan
from marlstone.llm.catalogue import tokenizer_path
from marlstone.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null text is judged as empty; a score of exactly 0.5 stays; repeated rows are judged alike.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of smallest doc_id.

    Texts that differ stay, also under one doc_id; of rows without words, and of rows that
    repeat a text without doc_id, one stays (of null and empty texts together as well).
    """
    return neardup.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the secrets masked; n_chars follows the text. Null texts stay null, every row stays."""
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken twice comes twice.

    Documents without words are not taken; of rows with equal finish times the hash of id and
    text decides, and rows that repeat both are taken together.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; each row is a document of its own, also one that repeats another."""
    return packing.pack_sequences(docs, tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier and the signatures can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
