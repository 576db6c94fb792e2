"""Corpus pipeline: documents in, packed token sequences out.

Five stages, each one operator of ``logweave.llm``.  A stage gets what its predecessor kept, as a
table written to and read from the shared folder, and returns the columns of ``documents`` but
for the last, which returns the packed pieces.

1. quality: documents that fail the base conditions or whose posterior quality is below one half go.
2. language: documents without a letter, or whose best language has a score below 0.4, go.
3. near_duplicates: of each SimHash group the document with the smallest doc_id stays.
4. secrets: every document stays; secrets in its text are replaced by their kind.
5. packing: what is left is tokenised and packed into sequences of at most 2,048 ids; the ids
   stay with their pieces, and ``packing.sequences`` joins them.

Null texts fail the first stage; repeated rows leave at the third; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import language, packing, quality, secrets, simhash
from logweave.llm.shared import materialise, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has no XXH64 fingerprint, field model or tokenizer; ``tests/llm`` holds the stages against
#: brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the ``documents`` table below ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
