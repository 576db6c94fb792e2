"""Log sources: raw-log stream (SRC1), text files (SRC2), line formats (SRC3), JSON line formats
(SRC4) and collector tag enrichment (SRC5).

Line formats are named regexes evaluated with ``regexp_extract`` (one call per field, inside
codegen); times are parsed with ``try_to_timestamp`` so that bad values give NULL.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference's collector configuration): line-format regexes and
# their time formats (Spark datetime patterns).
LINE_FORMATS = {
    "syslog": (r"^\<(?<pri>[0-9]+)\>(?<time>[^ ]* {1,2}[^ ]* [^ ]*) (?<host>[^ ]*) (?<ident>[a-zA-Z0-9_\/\.\-]*)"
               r"(?:\[(?<pid>[0-9]+)\])?(?:[^\:]*\:)? *(?<message>.*)$", "MMM d HH:mm:ss"),
    "nginx": (r"^(?<remote>[^ ]*) (?<host>[^ ]*) (?<user>[^ ]*) \[(?<time>[^\]]*)\] \"(?<method>\S+)"
              r"(?: +(?<path>[^\"]*?)(?: +\S*)?)?\" (?<code>[^ ]*) (?<size>[^ ]*)"
              r"(?: \"(?<referer>[^\"]*)\" \"(?<agent>[^\"]*)\")?.*$", "dd/MMM/yyyy:HH:mm:ss Z"),
    "python": (r"^(?<level>DEBUG|INFO|WARNING|ERROR|CRITICAL):(?<module>[^:]+):(?<message>.*)$", None),
}
JSON_FORMATS = {
    "json": ("time", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "docker": ("time", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "opentelemetry": ("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
}
# Collector tag rules (pattern, fields added when absent).
TAG_RULES = [
    (r"^docker\.", {"environment": "docker"}),
    (r"^host\.", {"service": "host", "environment": "host"}),
    (r"^logs\.", {"service": "fluentbit", "environment": "docker"}),
]
# File inputs and their tags.
FILE_TAGS = [(r"/var/log/syslog$", "host.syslog", "syslog"), (r"\.log$", "host.logs", "json")]


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z][A-Za-z0-9_]*)>", pattern)


def parse_lines(df: DataFrame, fmt: str, line_col: str = "line", year: int = 1900) -> DataFrame:
    """SRC3: named fields of a line format plus ``time_parsed`` (NULL for unmatched lines).

    Year-less syslog times take ``year`` (1900 as Python's strptime; pass the current year
    for live data).
    """
    pattern, tfmt = LINE_FORMATS[fmt]
    s = F.col(line_col)
    cols = {n: F.regexp_extract(s, pattern, i + 1) for i, n in enumerate(group_names(pattern))}
    matched = s.rlike(pattern)
    out = df.withColumn("matched", matched)
    for n, c in cols.items():
        out = out.withColumn(n, F.when(matched, c))
    if tfmt:
        if fmt == "syslog":
            t = F.try_to_timestamp(F.concat(F.lit(f"{year:04d} "), F.regexp_replace(F.col("time"), " +", " ")),
                                   F.lit("yyyy " + tfmt))
        else:
            t = F.try_to_timestamp(F.col("time"), F.lit(tfmt))
        out = out.withColumn("time_parsed", t.cast("timestamp_ntz"))
    return out


def parse_json_lines(df: DataFrame, fmt: str = "json", line_col: str = "line",
                     time_key: str | None = None, time_format: str | None = None) -> DataFrame:
    """SRC4: JSON line -> MAP<STRING,STRING> of its top-level fields, parsed time, original kept."""
    tk, tf = JSON_FORMATS[fmt]
    tk, tf = time_key or tk, time_format or tf
    v = F.try_parse_json(F.col(line_col))
    t = F.try_variant_get(v, "$." + tk, "string")
    return df.withColumn("fields", F.from_json(F.col(line_col), "map<string,string>")) \
        .withColumn("time_parsed", F.try_to_timestamp(t, F.lit(tf)).cast("timestamp_ntz"))


def enrich_by_tag(df: DataFrame, tag_col: str = "tag", fields: tuple[str, ...] = ("service", "environment")) -> DataFrame:
    """SRC5: fields added by tag rule; an existing value is kept ("Add" semantics)."""
    tag = F.col(tag_col)
    out = df
    for f in fields:
        rule = F.lit(None).cast("string")
        for pat, adds in reversed(TAG_RULES):
            if f in adds:
                rule = F.when(tag.rlike(pat), F.lit(adds[f])).otherwise(rule)
        cur = F.col(f) if f in df.columns else F.lit(None).cast("string")
        out = out.withColumn(f, F.coalesce(cur, rule))
    return out


def read_log_files(spark: SparkSession, paths: list[str] | str, stream: bool = False,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC2: text log files (batch or tailing stream), one row per line with path and tag.

    A stream is the union of one file source a path."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if stream:
        def tail(one: str) -> DataFrame:
            r = spark.readStream.format("text")
            if max_files_per_trigger:
                r = r.option("maxFilesPerTrigger", max_files_per_trigger)
            return r.load(one).select("value", "_metadata")
        df = reduce(DataFrame.unionByName, map(tail, paths))
    else:
        df = spark.read.text(paths).select("value", "_metadata")
    path = F.col("_metadata.file_path")
    tag = F.lit(None).cast("string")
    parser = F.lit(None).cast("string")
    for pat, t, p in reversed(FILE_TAGS):
        tag = F.when(path.rlike(pat), F.lit(t)).otherwise(tag)
        parser = F.when(path.rlike(pat), F.lit(p)).otherwise(parser)
    return df.select(F.col("value").alias("line"), path.alias("path"), tag.alias("tag"), parser.alias("parser"))


def read_raw_stream(spark: SparkSession, opts: dict | None = None) -> DataFrame:
    """SRC1: raw-log stream.  Kafka (topic ``logs-raw``, earliest offsets, bounded records per
    trigger) when the connector is on the classpath; ``opts['format']`` selects a file source
    (json/text lines) for tests.  Output: value STRING, topic, partition, offset, ingest_ts.

    Offsets that have expired stop the stream (the connector's ``failOnDataLoss`` stays on unless
    given).  For files, ``partition`` is the file with the start of the block read and ``offset`` is
    null; ``line_places`` numbers the lines of a micro-batch, so that the three name one line."""
    opts = dict(opts or {})
    fmt = opts.pop("format", "kafka")
    if fmt == "kafka":
        r = spark.readStream.format("kafka") \
            .option("subscribe", opts.pop("topic", "logs-raw")) \
            .option("startingOffsets", opts.pop("startingOffsets", "earliest")) \
            .option("maxOffsetsPerTrigger", opts.pop("maxOffsetsPerTrigger", 10000))
        for k, v in opts.items():
            r = r.option(k, v)
        df = r.load()
        return df.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset",
                         F.col("timestamp").cast("timestamp_ntz").alias("ingest_ts"))
    path = opts.pop("path")
    r = spark.readStream.format("text")
    for k, v in opts.items():
        r = r.option(k, v)
    df = r.load(path)
    return df.select(F.col("value"), F.lit("file").alias("topic"),
                     F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("partition"),
                     F.lit(None).cast("bigint").alias("offset"),
                     F.current_timestamp().cast("timestamp_ntz").alias("ingest_ts"))


def line_places(batch: DataFrame) -> DataFrame:
    """A micro-batch of ``read_raw_stream`` with null offsets filled: the line's place in the task
    that reads its block.  A block is read by one task, so no two lines share all three columns."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return batch.withColumn("offset", F.coalesce(F.col("offset"), place))
