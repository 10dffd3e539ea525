"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wardwise.llm import (
    ann, bm25, bpe, chat, language, license, negatives, packing, periodic, pii, simhash, suffix, toxicity,
)
from wardwise.llm.common import table


def op1_byte_bpe(spark, sf_dir):
    """Encode every text by the multilingual ranks, and decode the ids again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


def op2_bm25(spark, sf_dir):
    """The 10 best rows for every text whose id is divisible by 50, as a query, against all."""
    return bm25.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)


def op3_collision_ann(spark, sf_dir):
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_pii(spark, sf_dir):
    """Personal data in every text: base patterns, and what the field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.digests(docs, pii.learn(docs))


def op5_best_fit_packing(spark, sf_dir):
    """Pack all documents into sequences of 4096 word-BPE ids, each ended by id 1."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(table(spark, sf_dir, "documents"), path, size=4096, end_id=1)


def op6_language_id(spark, sf_dir):
    """Language of every text, learnt outside the fold that is held out."""
    return language.predicted(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    """Fingerprints of all texts, and the component each belongs to."""
    return simhash.clustered(table(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op9_toxicity(spark, sf_dir):
    """Toxicity of every text, learnt from labels outside the fold that is held out."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark, sf_dir):
    """Bytes of every text that a string of 400 repeated bytes covers, the text that is left, and shorter passages."""
    return suffix.digests(table(spark, sf_dir, "documents"), with_text=True, shorter=suffix.PASSAGE)


def op11_license_scan(spark, sf_dir):
    """License phrases in every text, and what its blocks share with license templates."""
    return license.digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every text, a tenth of them made periodic from some word on."""
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 100, a seventh of the labels moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mined(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_bm25": op2_bm25,
    "op3_collision_ann": op3_collision_ann,
    "op4_pii": op4_pii,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL where it can express the operator.
ORACLES = {
    "op8_chat_format": chat.ORACLE,
    "op11_license_scan": license.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
