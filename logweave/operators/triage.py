"""Triage data preparation around the model call.

The model call itself is outside Spark (a network service); these operators build its input
tables and parse its output tables.  Context lists are bounded (<= 5 similar logs, <= 3
cluster samples), so every per-key collect here holds at most a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICT_SCHEMA = "struct<is_anomaly:boolean,confidence:string,reasoning:string>"  # float("0.9") accepted
ROOT_CAUSE_SCHEMA = ("struct<explanation:string,"
                     "root_causes:array<struct<hypothesis:string,confidence:double,description:string>>,"
                     "remediation_steps:array<struct<step:string,priority:string,description:string>>,"
                     "severity:string,severity_reason:string>")
CONFIRM_CONFIDENCE = 0.6
# Fixed values (callers see these texts): what stands for a missing part of an answer, headings.
NO_REASONING = "No reasoning provided"
NO_EXPLANATION = "No explanation provided"
NO_REASON = "No reason provided"
UNPARSED = "Analysis completed but structured parsing failed"
CAUSES_HEADING = "\n\nRoot Causes:"
STEPS_HEADING = "\n\nRemediation Steps:"
SEVERITY_HEADING = "\n\nSeverity: "


def _is_object(c: Column) -> Column:
    v = F.try_parse_json(c)
    return v.isNotNull() & F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("0")))).startswith("OBJECT")


def context_text(neighbours: DataFrame, logs: DataFrame, n: int = 5,
                 key: str = "query_id", neighbour: str = "neighbor_id", order: str = "rank") -> DataFrame:
    """Numbered context lines ``i. [LEVEL] message`` of the first ``n`` context logs."""
    j = neighbours.filter(F.col(order) <= n).join(
        logs.select(F.col("log_id").alias(neighbour), "level", "message"), neighbour, "left")
    line = F.struct(F.col(order).alias("o"), F.concat(
        F.col(order).cast("string"), F.lit(". ["), F.coalesce("level", F.lit("N/A")), F.lit("] "),
        F.coalesce("message", F.lit(""))).alias("s"))
    return j.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("ls")).select(
        key, F.array_join(F.transform("ls", lambda x: x["s"]), "\n").alias("context_text"))


def cluster_context_text(clu: DataFrame, members: DataFrame, samples: int = 3, cut: int = 100) -> DataFrame:
    """Cluster id, size and up to ``samples`` member messages cut at ``cut`` characters."""
    w = Window.partitionBy("cluster_id").orderBy("log_id")
    m = members.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= samples)
    line = F.struct(F.col("i").alias("o"), F.concat(
        F.lit("  "), F.col("i").cast("string"), F.lit(". ["), F.coalesce("level", F.lit("N/A")), F.lit("] "),
        F.substring(F.coalesce("message", F.lit("")), 1, cut), F.lit("...")).alias("s"))
    s = m.groupBy("cluster_id").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    j = clu.select("cluster_id", "cluster_size").join(s, "cluster_id", "left")
    return j.select("cluster_id", F.concat_ws(
        "\n", F.concat(F.lit("- Cluster ID: "), F.col("cluster_id").cast("string")),
        F.concat(F.lit("- Cluster Size: "), F.col("cluster_size").cast("string")),
        F.lit("- Sample logs from cluster:"),
        F.transform(F.coalesce("ls", F.array().cast("array<struct<o:int,s:string>>")), lambda x: x["s"]))
        .alias("cluster_context"))


def build_prompts(df: DataFrame, kind: str = "root_cause") -> DataFrame:
    """One prompt row per candidate (our own wording), N/A defaults for missing fields.
    Expected columns: log_id, level, service, message, context_text, cluster_context."""
    head = F.lit("Analyse this log entry and answer in JSON." if kind == "verdict"
                 else "Explain why this log entry is anomalous; list root causes and remediation steps in JSON.")
    ctx = F.when(F.coalesce(F.col("context_text"), F.lit("")) != "",
                 F.concat(F.lit("\n\nSimilar logs:\n"), F.col("context_text"))).otherwise(F.lit(""))
    cl = F.when(F.coalesce(F.col("cluster_context"), F.lit("")) != "",
                F.concat(F.lit("\n\nCluster:\n"), F.col("cluster_context"))).otherwise(F.lit(""))
    prompt = F.concat(head, F.lit("\nLevel: "), F.coalesce("level", F.lit("N/A")),
                      F.lit("\nService: "), F.coalesce("service", F.lit("N/A")),
                      F.lit("\nMessage: "), F.coalesce("message", F.lit("")), ctx, cl)
    return df.select("log_id", F.lit(kind).alias("prompt_kind"), prompt.alias("prompt"))


def parse_verdicts(df: DataFrame, col: str = "response") -> DataFrame:
    """T4: (is_anomaly, confidence, reasoning) with defaults (false, 0.5, text); bad JSON or
    a non-object answer gives NULLs."""
    ok = _is_object(F.col(col))
    v = F.from_json(F.col(col), VERDICT_SCHEMA)
    return df.withColumn("is_anomaly", F.when(ok, F.coalesce(v["is_anomaly"], F.lit(False)))) \
        .withColumn("confidence", F.when(ok, F.coalesce(v["confidence"].try_cast("double"), F.lit(0.5)))) \
        .withColumn("reasoning", F.when(ok, F.coalesce(v["reasoning"], F.lit(NO_REASONING))))


def parse_root_cause(df: DataFrame, col: str = "response", fallback: Column | None = None) -> DataFrame:
    """T5: structured root cause with defaults; bad JSON gives an explanation-only row (the
    fallback explanation, severity MEDIUM), or NULLs when there is no fallback."""
    ok = _is_object(F.col(col))
    v = F.from_json(F.col(col), ROOT_CAUSE_SCHEMA)
    fb = fallback if fallback is not None else F.lit(None).cast("string")
    has = ok | fb.isNotNull()
    empty_rc = F.array().cast("array<struct<hypothesis:string,confidence:double,description:string>>")
    empty_st = F.array().cast("array<struct<step:string,priority:string,description:string>>")
    return df.withColumn("explanation", F.when(ok, F.coalesce(v["explanation"], F.lit(NO_EXPLANATION)))
                         .otherwise(fb)) \
        .withColumn("root_causes", F.when(ok, F.coalesce(v["root_causes"], empty_rc)).when(has, empty_rc)) \
        .withColumn("remediation_steps", F.when(ok, F.coalesce(v["remediation_steps"], empty_st)).when(has, empty_st)) \
        .withColumn("severity", F.when(ok, F.coalesce(v["severity"], F.lit("MEDIUM"))).when(has, F.lit("MEDIUM"))) \
        .withColumn("severity_reason", F.when(ok, F.coalesce(v["severity_reason"], F.lit(NO_REASON)))
                    .when(has, F.lit(UNPARSED)))


def confirmed(df: DataFrame, threshold: float = CONFIRM_CONFIDENCE) -> DataFrame:
    """The model confirms the outlier (is_anomaly and confidence >= threshold)."""
    return df.withColumn("confirmed", F.coalesce(F.col("is_anomaly") & (F.col("confidence") >= threshold),
                                                 F.lit(False)))


def render_reasoning(df: DataFrame) -> DataFrame:
    """Text form of a parsed root cause."""
    rc, st = F.col("root_causes"), F.col("remediation_steps")
    causes = F.transform(rc, lambda c: F.concat(F.lit("- "), F.coalesce(c["hypothesis"], F.lit("Unknown")),
                                                 F.lit(": "), F.coalesce(c["description"], F.lit(""))))
    steps = F.transform(st, lambda s: F.concat(F.lit("- ["), F.coalesce(s["priority"], F.lit("MEDIUM")),
                                                F.lit("] "), F.coalesce(s["step"], F.lit("Unknown")),
                                                F.lit(": "), F.coalesce(s["description"], F.lit(""))))
    text = F.concat_ws("\n", F.coalesce(F.col("explanation"), F.lit("")),
                       F.when(F.size(rc) > 0, F.concat(F.array(F.lit(CAUSES_HEADING)), causes)),
                       F.when(F.size(st) > 0, F.concat(F.array(F.lit(STEPS_HEADING)), steps)),
                       F.concat(F.lit(SEVERITY_HEADING), F.coalesce(F.col("severity"), F.lit("MEDIUM")),
                                F.lit(" - "), F.coalesce(F.col("severity_reason"), F.lit(""))))
    return df.withColumn("rendered", F.when(F.col("explanation").isNotNull(), text))


def cap(df: DataFrame, n: int = 5, score: str = "anomaly_score") -> DataFrame:
    """At most ``n`` candidates per run, highest score first (id tie-break)."""
    return df.orderBy(F.col(score).desc(), F.col("log_id")).limit(n)


def choose_reasoning(df: DataFrame) -> DataFrame:
    """Root cause text, else verdict reasoning, else plain explanation (+ its source)."""
    return df.withColumn("llm_reasoning", F.coalesce("rendered", "reasoning", "plain_explanation")) \
        .withColumn("reasoning_source", F.when(F.col("rendered").isNotNull(), "root_cause")
                    .when(F.col("reasoning").isNotNull(), "verdict")
                    .when(F.col("plain_explanation").isNotNull(), "explanation"))


def route_context(ids: DataFrame, anom: DataFrame, clu: DataFrame) -> DataFrame:
    """Cluster context when the log sits in an existing real cluster (B27: cluster 0
    counts), otherwise similar-log context."""
    a = anom.select("log_id", "cluster_id")
    c = clu.select(F.col("cluster_id").alias("c_id"))
    j = ids.select("log_id").join(a, "log_id", "left").join(c, F.col("cluster_id") == F.col("c_id"), "left")
    kind = F.when(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != -1) & F.col("c_id").isNotNull(),
                  "cluster").otherwise("similar")
    return j.select("log_id", "cluster_id", kind.alias("context_kind"))
