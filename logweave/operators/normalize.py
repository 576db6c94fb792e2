"""Raw JSON record -> processed log row, with a quarantine path.

One narrow projection over the input (no shuffle): parse once to VARIANT, probe fields, type
checks (B6) become a ``reject_reason`` column instead of silent loss, PII redaction runs as
successive projections.  ``split_rejected`` gives the two outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.common import col
from ..functions.pii import let, redact_frame

PROCESSED_COLUMNS = ["log_id", "timestamp", "level", "service", "message", "raw_log",
                     "metadata", "pii_redacted", "pii_entities", "reject_reason"]


PROBE_KEYS = list(dict.fromkeys(N.MESSAGE_KEYS + N.TIMESTAMP_KEYS +
                                 ["container_name", "service", "tag", "level", "metadata", "log_type"]))
_IDX = {k: i for i, k in enumerate(PROBE_KEYS)}


def _probe(v: Column) -> Column:
    """All field probes of a record, computed once: per key its JSON type, string value and
    Python truthiness (lambda variables keep the record and each probe from being re-evaluated,
    also where a filter on the reason is pushed below the projection that parses the record)."""
    def probes(v):
        return F.struct(
            v.isNull().alias("isnull"),
            F.coalesce(F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("null")))).startswith("OBJECT"),
                       F.lit(False)).alias("obj"),
            *[N.vtype(v, k).alias(f"t{i}") for i, k in enumerate(PROBE_KEYS)],
            *[N.vget(v, k).alias(f"s{i}") for i, k in enumerate(PROBE_KEYS)],
            v.alias("v"))

    def finish(r):
        cols = [r["obj"].alias("obj")]
        t, sv, b = {}, {}, {}
        for i, k in enumerate(PROBE_KEYS):
            t[k], sv[k] = r[f"t{i}"], r[f"s{i}"]
            d = N.vget(r["v"], k, "double")      # only evaluated for numeric fields
            b[k] = (F.when(t[k] == "STRING", sv[k] != "").when(t[k].isin(N.NUMERIC_TYPES), d != 0)
                    .when(t[k] == "BOOLEAN", sv[k] == "true").when(t[k].isin("OBJECT", "ARRAY"), ~sv[k].isin("{}", "[]"))
                    .otherwise(F.lit(False)))
            cols += [t[k].alias(f"t{i}"), sv[k].alias(f"s{i}"), b[k].alias(f"b{i}")]
            if k in N.MESSAGE_KEYS:
                cols.append(N.shown_text(sv[k], t[k], d).alias(f"m{i}"))
        # B6 checks inside the same binding: a pushed-down filter on the reason then evaluates
        # the probes once, not once per referenced field.
        svc_key = F.when(b["container_name"], "container_name").when(b["service"], "service").when(b["tag"], "tag")

        def str_or_null(k):
            return t[k].isNull() | t[k].isin("VOID", "STRING")
        reject = (F.when(r["isnull"], F.lit("invalid_json"))
                  .when(~r["obj"], F.lit("not_object"))
                  .when(~str_or_null("level"), F.lit("level_type"))
                  .when((svc_key == "container_name") & (t["container_name"] != "STRING"), F.lit("service_type"))
                  .when((svc_key == "service") & (t["service"] != "STRING"), F.lit("service_type"))
                  .when((svc_key == "tag") & (t["tag"] != "STRING"), F.lit("service_type"))
                  .when(svc_key.isNull() & ~str_or_null("service"), F.lit("service_type"))
                  .when(t["metadata"].isNotNull() & (t["metadata"] != "OBJECT"), F.lit("metadata_type"))
                  .when(~str_or_null("log_type"), F.lit("log_type_type")))
        return F.struct(*cols, reject.alias("reject"))
    return let(let(v, probes), finish)


def _t(k):
    return F.col(f"_p.t{_IDX[k]}")


def _s(k):
    return F.col(f"_p.s{_IDX[k]}")


def _b(k):
    return F.col(f"_p.b{_IDX[k]}")


def _first(keys, what):
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(_b(k), what(k)).otherwise(out)
    return out


def normalize_records(raw: DataFrame, value_col: str = "value", as_of: Column | str | None = None,
                      id_cols: list[str] | None = None, prefix: str = N.CONTAINER_PREFIX,
                      redact: bool = True) -> DataFrame:
    """Normalise every row; rows that the reference would drop carry a ``reject_reason``.

    ``as_of`` is the fallback "now" for rows without any timestamp (``current_timestamp()``
    in a stream; a fixed literal in batch so reruns agree).  ``log_id`` is deterministic
    (B1): sha2 over ``id_cols`` (e.g. topic, partition, offset) or over the raw text.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else \
        (F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of)
    df = raw.withColumn("_v", N.parse_record(value_col))
    df = df.withColumn("_p", _probe(F.col("_v")))
    meta_t = _t("metadata")
    reject = F.col("_p.reject")
    df = df.withColumn("reject_reason", reject)
    # First level from the probes, nested levels re-parse the (rare) nested JSON text
    df = df.withColumn("_m0", _first(N.MESSAGE_KEYS, lambda k: F.col(f"_p.m{_IDX[k]}")))
    df = N.with_message_from(df, "_m0", "_msg")
    # N3/N4
    ts_key = _first(N.TIMESTAMP_KEYS, lambda k: F.lit(k))
    ts_text = _first(N.TIMESTAMP_KEYS, _s)
    ts_type = _first(N.TIMESTAMP_KEYS, _t)
    df = df.withColumn("_ts", F.when(ts_key.isNotNull() & (ts_type == "STRING"), N.parse_timestamp(ts_text)))
    # N2
    cn = _s("container_name")
    cn_clean = F.regexp_replace(F.regexp_replace(cn, "^/", ""), "^" + prefix.replace(".", r"\."), "")
    tag = _s("tag")
    extracted = F.when(_b("container_name"), cn_clean).when(_b("service"), _s("service")) \
        .when(_b("tag"), F.when(tag.startswith("docker."), F.substring(tag, 8, 1 << 30)))
    df = df.withColumn("_lvl", _s("level"))
    df = df.withColumn("_svc", F.when(N.truthy(extracted), extracted).otherwise(_s("service")))
    df = df.withColumn("_meta", F.when(meta_t == "OBJECT", F.from_json(_s("metadata"), "map<string,string>"))
                       .otherwise(F.create_map().cast("map<string,string>")))
    df = df.withColumn("_lt", _s("log_type"))
    df = df.withColumn("timestamp", N.resolve_timestamp(F.col("_ts"), F.col("_msg"), now))
    df = df.withColumn("level", N.resolve_level(F.col("_msg"), F.col("_meta"), F.col("_lvl")))
    df = df.withColumn("service", N.resolve_service(F.col("_msg"), F.col("_meta"), F.col("_lt"), F.col("_svc")))
    df = df.withColumn("metadata", N.merge_metadata(F.col("_meta"), F.col("level"), F.col("service"), F.col("_lt")))
    if redact:
        df = redact_frame(df, "_msg", "message")
    else:
        df = df.withColumn("message", F.col("_msg")).withColumn("pii_redacted", F.lit(False)) \
            .withColumn("pii_entities", F.create_map().cast("map<string,int>"))
    key = F.concat_ws("|", *[col(c).cast("string") for c in id_cols]) if id_cols else F.col(value_col)
    df = df.withColumn("log_id", F.sha2(key, 256)).withColumn("raw_log", F.col(value_col))
    keep = [c for c in raw.columns if c not in PROCESSED_COLUMNS and c != value_col]
    return df.select(*keep, *PROCESSED_COLUMNS)


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Persist ``df`` first when both are consumed."""
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason"), \
        df.filter(F.col("reject_reason").isNotNull())
