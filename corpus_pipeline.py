"""Corpus pipeline: the stages that turn ``documents`` into training data.

Every stage takes the documents that the one before kept, acts on what it finds, and returns the
columns of ``documents``; the last returns their tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.bpe import encode_texts
from scriptloom.llm.decontaminate import clean_documents
from scriptloom.llm.quality import good_documents
from scriptloom.llm.scratch import durable
from scriptloom.llm.secrets import redact_secrets
from scriptloom.llm.simhash import first_of_each_group

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (a score under 0.5) go.

    Null and empty texts are judged as an empty passage, null ids and repeated rows like any other row;
    without labels of both classes, and in an empty table, nothing goes.
    """
    return good_documents(docs.select(*COLUMNS), _read(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that of the smallest doc_id: five-word shingles, 0.8 alike.

    Texts without words, null ones among them, are one group. Rows with a null id stay, as do all rows
    that repeat the id of a kept document. An empty table stays empty.
    """
    return first_of_each_group(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all words of a shorter one, go.

    Null and empty texts, and null or empty items, have no words and hit nothing; rows with null or
    repeated ids are judged each by its own text. Without items nothing goes.
    """
    return clean_documents(docs, _read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, n_chars follows the text.

    A null text stays null (n_chars too); null and repeated ids are rows like any other.
    """
    found = redact_secrets(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text.

    Null and empty texts have no tokens; null and repeated ids are rows like any other.
    """
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The stages train models and hash with XXH64; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read again."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
