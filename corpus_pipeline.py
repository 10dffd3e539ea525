"""The corpus pipeline: filter, deduplicate, redact and pack ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.
Texts that a stage empties stay as empty documents, null texts stay null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwise.llm import packing, pii, simhash, suffix, toxicity
from wardwise.llm.common import importable, table
from wardwise.sources.tables import shared_folder

#: bytes of a repeated passage: one of 50 words has 270 and more
PASSAGE = 240


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not reject."""
    importable(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    names = "_score", "_rejected"
    while set(names) & set(docs.columns):  # a given column keeps its values
        names = tuple(f"_{n}" for n in names)
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id."""
    importable(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of ``PASSAGE`` bytes cover."""
    importable(spark)
    return _recounted(suffix.without_repeats(docs, length=PASSAGE))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    importable(spark)
    return _recounted(pii.redact(docs, pii.learn(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of 4096 tokens."""
    importable(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pii", redact),
    ("packing", pack),
]

#: learnt models, fingerprints by votes and bytes cut from texts are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
