import json

from logweave.operators import raw_lines as RL
from logweave.operators.normalize import normalize_records

SCHEMA = "seq bigint, arrival_ms bigint, value string"


def frame(spark, records):
    return spark.createDataFrame([(i, i * 10, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], SCHEMA)


def test_keys_and_lines(spark):
    records = [{"log": "a\n\n", "message": "b", "container_name": "/web", "container_id": "0123456789abcdef", "service": "s"},
               {"log": "", "message": "b", "service": "s"}, {"text": "t", "container_name": None}, {"msg": 5},
               {"message": "\n"}, {"other": "x"}, "[1]", "not json"]
    got = [(r.seq, r.src, r.line) for r in RL.to_lines(frame(spark, records)).orderBy("seq").collect()]
    assert got == [(0, "/web:0123456789ab", "a"), (1, "s:", "b"), (2, "None:", "t"), (3, "unknown:", "5")]


def test_assembled_records_take_the_first_lines_fields(spark):
    base = {"container_name": "web", "container_id": "c" * 20}
    records = [{**base, "log": "ERROR:app:failed", "pod": {"name": "p", "n": [1, 2.5, None]}, "level": "info", "message": "old"},
               {**base, "log": "  more", "pod": "other"}, {**base, "log": "INFO:app:ok", "n": 1}, {**base, "log": "WARN:app:slow", "level": "warn"}]
    rows = RL.assemble_records(frame(spark, records)).orderBy("first_seq").collect()
    assert [(r.src, r.first_seq, r.line_count, r.aggregated) for r in rows] == [
        ("web:" + "c" * 12, 0, 2, True), ("web:" + "c" * 12, 2, 1, False), ("web:" + "c" * 12, 3, 1, True)]
    joined = "ERROR:app:failed\n  more"
    assert json.loads(rows[0].value) == {**base, "pod": {"name": "p", "n": [1, 2.5, None]}, "message": joined, "log": joined,
                                         "_aggregated": True, "_line_count": 2, "level": "ERROR", "_detected_error": True}
    assert json.loads(rows[1].value) == records[2]
    assert json.loads(rows[2].value) == {**base, "level": "warn", "message": "WARN:app:slow", "log": "WARN:app:slow",
                                         "_aggregated": True, "_line_count": 1}
    # and on to the processed rows
    done = normalize_records(RL.assemble_records(frame(spark, records)), as_of="2024-01-20", id_cols=["src", "first_seq"])
    assert {r.message for r in done.collect()} == {joined, "INFO:app:ok", "WARN:app:slow"}
