"""Result validation (W1, W2): repair response rows and report structural issues.

A response page is one JSON body; its rows are exploded with their index (``posexplode``)
and repaired field by field with built-in variant probes — one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (callers see these texts): required fields and issue texts.
NOT_AN_OBJECT, MISSING = "Expected object, got ", "Missing required field: "
LOGS_FIELD = 'Found "logs" field instead of expected "results" field'
RESULTS_TYPE = 'Field "results" should be array, got '
REQUIRED_FIELDS = ["results", "total", "limit", "offset"]
_NUM = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"]


def _t(v: Column, path: str) -> Column:
    sub = F.try_variant_get(v, path, "variant")
    return F.when(sub.isNotNull(), F.regexp_extract(F.schema_of_variant(sub), r"^([A-Z]+)", 1))


def _js_type(t: Column) -> Column:
    return (F.when(t == "STRING", "string").when(t.isin(_NUM), "number").when(t == "BOOLEAN", "boolean")
            .when(t.isNull(), "undefined").otherwise("object"))


def _str_field(e: Column, key: str, default: Column) -> Column:
    s = F.try_variant_get(e, f"$.{key}", "string")
    return F.when((_t(e, f"$.{key}") == "STRING") & (s != ""), s).otherwise(default)


def repair_rows(pages: DataFrame, body_col: str = "body", as_of: str = "1970-01-01T00:00:00") -> DataFrame:
    """One repaired row per object element of ``results`` (or ``logs``); non-object
    elements are dropped; ``id`` falls back to ``unknown-<index>``, level INFO, service
    unknown, message "", timestamp ``as_of``; optional fields that are empty texts, wrong-typed or
    outside their values become NULL.  Objects come back as JSON text."""
    v = F.try_parse_json(F.col(body_col))
    res = F.when(_t(v, "$.results") == "ARRAY", F.try_variant_get(v, "$.results", "array<variant>")) \
        .when(_t(v, "$.logs") == "ARRAY", F.try_variant_get(v, "$.logs", "array<variant>"))
    keep = [c for c in pages.columns if c != body_col]
    ex = pages.select(*keep, F.posexplode(res).alias("idx", "e"))
    e = F.col("e")
    ex = ex.filter(_t(e, "$") == "OBJECT")
    null = F.lit(None).cast("string")

    def typed(key: str, kinds: list[str], as_type: str) -> Column:
        return F.when(_t(e, f"$.{key}").isin(kinds), F.try_variant_get(e, f"$.{key}", as_type)).alias(key)

    tier = F.try_variant_get(e, "$.hybrid_tier", "string")
    return ex.select(
        *keep, "idx",
        _str_field(e, "id", F.concat(F.lit("unknown-"), F.col("idx").cast("string"))).alias("id"),
        _str_field(e, "timestamp", F.lit(as_of)).alias("timestamp"),
        _str_field(e, "level", F.lit("INFO")).alias("level"),
        _str_field(e, "service", F.lit("unknown")).alias("service"),
        _str_field(e, "message", F.lit("")).alias("message"),
        typed("is_anomaly", ["BOOLEAN"], "boolean"), typed("cluster_id", _NUM, "double"),
        typed("anomaly_score", _NUM, "double"), typed("metadata", ["OBJECT", "ARRAY"], "string"),
        *[_str_field(e, k, null).alias(k) for k in ("redacted_message", "llm_reasoning", "detection_method", "created_at")],
        typed("llm_validated", ["BOOLEAN"], "boolean"), typed("pii_redacted", ["BOOLEAN"], "boolean"),
        F.when(tier.isin("tier1", "tier2"), tier).alias("hybrid_tier"),
        typed("pii_entities_detected", ["OBJECT", "ARRAY"], "string"))


def validate_structure(pages: DataFrame, body_col: str = "body",
                       required: list[str] | None = None) -> DataFrame:
    """Structural issues per page (one row per issue)."""
    required = required or REQUIRED_FIELDS
    v = F.try_parse_json(F.col(body_col))
    top = _t(v, "$")
    is_obj = F.coalesce(top.isin("OBJECT", "ARRAY"), F.lit(False))   # JS: typeof [] == "object"
    issues = [F.when(~is_obj, F.concat(F.lit(NOT_AN_OBJECT), _js_type(top)))]
    issues += [F.when(is_obj & _t(v, f"$.{f}").isNull(), F.lit(MISSING + f)) for f in required]
    issues.append(F.when(is_obj & _t(v, "$.results").isNull() & _t(v, "$.logs").isNotNull(),
                         F.lit(LOGS_FIELD)))
    rt = _t(v, "$.results")
    issues.append(F.when(is_obj & rt.isNotNull() & (rt != "ARRAY"),
                         F.concat(F.lit(RESULTS_TYPE), _js_type(rt))))
    keep = [c for c in pages.columns if c != body_col]
    return pages.select(*keep, F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("issue"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
