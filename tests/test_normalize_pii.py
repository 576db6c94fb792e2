import json

from pyspark.sql import functions as F

from logweave.functions import normalize as N
from logweave.functions import pii as P
from logweave.operators.normalize import normalize_records


def test_level_service_golden(spark):
    df = spark.createDataFrame([
        ("ERROR: Database connection failed", None, None),
        ("service=backend Database connection failed", None, None),
        ("GET /x HTTP/1.1\" 503 1", None, None),
        ("[CRITICAL] oom", "critical", None),
        ("just text", None, "warning"),
    ], "msg string, lvl string, lvl2 string")
    meta = F.create_map(F.lit("level"), F.col("lvl2"))
    r = df.select(N.resolve_level("msg", meta, F.col("lvl")).alias("l"),
                  N.resolve_service("msg", None, None, None).alias("s")).collect()
    assert [x.l for x in r] == ["ERROR", "INFO", "ERROR", "CRITICAL", "WARN"]
    assert r[1].s == "backend"


def test_redaction_golden(spark):
    df = spark.createDataFrame([
        ("mail kim.lee@acme.test, call 212-555-0187 after six",),
        ("",),
        ("client 10.1.0.5:8080 id 123e4567-e89b-12d3-a456-426614174000 card 4532015112830366,",),
        ("order 4929-0000-1111-2222 shipped",),
        ("kernel: [ 12.5] oom u@example.com",),
        ("2023-07-04T08:09:10 job finished, report sent to kim.lee@acme.test",),
    ], "text string")
    r = P.redact_frame(df, "text", "out").collect()
    assert "kim.lee@acme.test" not in r[0].out and "212-555-0187" not in r[0].out
    assert r[1].out == "" and r[1].pii_entities == {}
    assert r[2].out == "client [IP]:[PORT] id [UUID] card [CREDIT_CARD],"
    assert "CREDIT_CARD" not in r[3].pii_entities          # not Luhn-valid
    assert r[4].out == "kernel: [ 12.5] oom u@example.com"   # kernel bypass
    assert r[5].out.startswith("2023-07-04T08:09:10 job finished") and "kim.lee" not in r[5].out


def test_normalize_record_golden(spark):
    raw = spark.createDataFrame([
        ('{"time":"2023-07-04T08:09:10.5","level":"error","msg":"queue full, told ops@acme.test","service":"mailer","metadata":{"host":"n7"},"log_type":"text"}',),
        ('{"message":"x","level":5}',),
        ('not json',),
    ], "value string")
    out = normalize_records(raw, as_of="2024-01-20 00:00:00").orderBy("raw_log").collect()
    by = {r.raw_log[:5]: r for r in out}
    ok = by['{"tim']
    assert ok.level == "ERROR" and ok.service == "mailer" and ok.pii_redacted
    assert ok.metadata["host"] == "n7" and ok.metadata["extracted_level"] == "ERROR"
    assert by['{"mes'].reject_reason == "level_type"
    assert by["not j"].reject_reason == "invalid_json"


def nested(depth):
    text = "the core"
    for _ in range(depth):
        text = json.dumps({"message": text})
    return text


def test_messages_of_any_depth_and_type(spark):
    cases = [(nested(1), "the core"), (nested(6), "the core"), (nested(9), "the core"),
             (json.dumps({"message": "\t\n " + nested(1)}), "the core"),
             (json.dumps({"log": json.dumps({"other": 1})}), ""), (json.dumps({"msg": "{not json"}), "{not json"),
             ('{"message": 5.0}', "5.0"), ('{"message": 7}', "7"), ('{"message": true}', "True"),
             ('{"message": 12345678.9}', "12345678.9"), ('{"message": 1e20}', "1e+20"), ('{"message": 2.5e-7}', "2.5e-07"),
             ('{"message": 0.5}', "0.5"), ('{"message": false, "text": "t"}', "t")]
    raw = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "n int, value string")
    got = [r.message for r in N.with_message(raw).orderBy("n").collect()]
    assert got == [want for _, want in cases]
    whole = normalize_records(raw, as_of="2024-01-20 00:00:00", redact=False, id_cols=["n"]).orderBy("n").collect()
    assert [r.message for r in whole] == got


def test_timestamps_with_one_digit_fields(spark):
    cases = [("2024-1-5 1:02:03", "2024-01-05 01:02:03"), ("2024-1-5T1:2:3", "2024-01-05 01:02:03"),
             ("2024-11-15T10:30:45.5", "2024-11-15 10:30:45.5"), ("2024-01-05T01:02:03Z", None),
             ("Jan  5 1:02:03", "1900-01-05 01:02:03"), ("oct 15 10:30:45", "1900-10-15 10:30:45"), ("24-1-5 1:02:03", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "n int, s string")
    got = df.select("n", N.parse_timestamp("s").cast("string").alias("t")).orderBy("n").collect()
    assert [r.t for r in got] == [want for _, want in cases]


def test_native_plan_has_no_python(spark, tables):
    df = P.redact_frame(tables.pii_lines, "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
