"""Registered queries of the training-data operators: each over its whole table.

``QUERIES`` maps ``opN_<name>`` to ``fn(spark, sf_dir)``; ``ORACLE_SQL`` holds DuckDB SQL for
those whose rows SQL can express.  The others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, language, packing, page_text, periodic_runs, prefix_forest, quality, secrets, simhash, surrogates,
               token_alignment, url_filter, warc)
from .shared import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


@query
def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read_table(spark, sf_dir, "documents"))


@query
def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


ORACLE_SQL["op10_warc"] = warc.ROUND_TRIP_SQL


@query
def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


#: The key of the registered query; a real corpus takes its own from where secrets are kept.
SURROGATE_KEY = "registered query"


@query
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.query_rows(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query
def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(read_table(spark, sf_dir, "embeddings"))


@query
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op11_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.contract_rules(pages))


ORACLE_SQL["op11_url_digests"] = url_filter.JUDGE_SQL


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(read_table(spark, sf_dir, "documents"), periodic_runs.contract_rewrite)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(read_table(spark, sf_dir, "documents"))
