"""A training corpus from raw documents, in stages: each takes all that the one before kept and returns a DataFrame.

All stages but the last return the columns of ``documents``; the last returns one row per piece of a packed document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedweir.llm import mixing, near, packing, phrases, quality
from feedweir.llm.queries import BYTE_BPE, domains, table
from feedweir.llm.scratch import Scratch, configure

#: Shares of tokens in the corpus that the stages before have cleaned.
TARGETS = {"clean": 0.90, "toxic": 0.08, "poor": 0.02}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go."""
    return quality.accepted(docs, table(configure(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    return near.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out of the texts."""
    return phrases.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains meet their target shares of tokens."""
    return mixing.mixed(docs, domains(configure(spark), sf_dir), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens: doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", source_mixing),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what each keeps is written once and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model, hash signatures and a tokenizer are beyond SQL; every stage is tested against a brute-force version.
ORACLE_SQL = None
