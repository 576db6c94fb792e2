"""Expensive expressions stay where they are written once, whatever filter follows; rows are dealt evenly."""

import contextlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.functions import pii as P
from logweave.operators import normalize as NO
from logweave.operators import raw_lines as RL
from logweave.operators.partitioning import deal
from logweave.plans import q_normalize, q_pii
from logweave.sources.tables import BASE_TABLES

RECORDS = ['{"message": "a", "level": "error"}', '{"message": "b", "level": 5}', "[1]", "no json", None,
           '{"log": "x\\n", "service": "s"}', '{"log": ""}']


def _plan(spark, df) -> str:
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rec") / "r")
    spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "rec_id long, value string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of 4,000 events in one row group; the others have no rows that matter here."""
    path = tmp_path_factory.mktemp("tables")
    events = """select i as event_id, timestamp '2024-01-01' as ts, i % 50 as user_id, 'view' as event_type, 1.5 as value,
                '{"k": 1}' as props from range(4000) t(i)"""
    for name in BASE_TABLES:
        sql = events if name == "events" else f"select * from '/root/testdata/sf0.001/{name}.parquet' limit 1"
        duckdb.sql(f"copy ({sql}) to '{path}/{name}.parquet'")
    return str(path)


def test_a_filter_on_the_reason_parses_a_record_no_more_often(spark, records):
    _, rejected = NO.split_rejected(NO.normalize_records(records, as_of="2024-01-01", id_cols=["rec_id"]))
    rejected = rejected.select("rec_id", "reject_reason", "raw_log")
    assert sorted((r.rec_id, r.reject_reason) for r in rejected.collect()) == \
        [(1, "level_type"), (2, "not_object"), (3, "invalid_json"), (4, "invalid_json")]
    assert _plan(spark, rejected).count("parseJson(value") <= 3


def test_a_filter_on_the_line_parses_a_record_once(spark, records):
    lines = RL.to_lines(records.withColumn("arrival_ms", F.col("rec_id") * 10), seq_col="rec_id")
    assert sorted((r.seq, r.src, r.line, r.value) for r in lines.collect()) == \
        [(0, "unknown:", "a", RECORDS[0]), (1, "unknown:", "b", RECORDS[1]), (5, "s:", "x", RECORDS[5])]
    assert _plan(spark, lines).count("parseJson(value") == 1


def test_entity_rows_redact_a_text_once(spark, folder):
    out = q_pii.q_p7(spark, folder)
    once = _plan(spark, P.redact_frame(spark.range(1).select(F.col("id").cast("string").alias("text")), "text")
                 .select("pii_entities")).count("[CLOUD_HOST]")
    assert _plan(spark, out).count("[CLOUD_HOST]") == once
    assert {r.entity_type for r in out.select("entity_type").distinct().collect()} <= \
        {"IP_ADDRESS", "UUID", "CLOUD_HOST", "EMAIL_ADDRESS", "CREDIT_CARD"}


def test_rows_of_one_row_group_are_dealt_over_all_tasks(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    for query in (q_normalize.q_n11, q_normalize.q_n11_rejects, q_pii.q_p7):
        assert query(spark, folder).rdd.getNumPartitions() >= 4 * cores
    sizes = [len(x) for x in deal(spark.read.parquet(f"{folder}/events.parquet")).rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / len(sizes)
