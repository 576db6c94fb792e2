"""PII detection spans (P6) and corpus inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii as P


def _len_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + F.length(x))


def detect_pii(df: DataFrame, text_col: str, id_col: str | None = None,
               threshold: float | None = None) -> DataFrame:
    """One row per detected span ``(entity_type, start, end, score)`` (0-based, end
    exclusive), computed on the text as given (no redaction phases).

    Offsets come from the same regex scan as the matches: ``split(text, pattern)`` yields the
    gaps between consecutive matches, so the start of match i is the length of the first i
    gaps plus the first i matches.  Everything stays in built-in expressions.
    """
    s = F.coalesce(F.col(text_col), F.lit(""))
    spans = []
    table = [("IP_ADDRESS", P.between_words(P.IP_PORT_PATTERN), 0.95, [], None)] + P.RECOGNISERS
    for entity, pattern, base, context, check in table:
        matches = F.regexp_extract_all(s, F.lit(pattern), 0)
        pieces = F.split(s, pattern, -1)
        ctx = s.rlike("(?i)\\b(" + "|".join(context) + ")\\b") if context else F.lit(False)
        def mk(m, i, entity=entity, base=base, check=check, ctx=ctx, pieces=pieces, matches=matches):
            start = _len_sum(F.slice(pieces, 1, i + 1)) + _len_sum(F.slice(matches, 1, i))
            if base >= 1.0:
                score = F.lit(float(base))
            elif check is not None:
                score = F.when(P._valid(check, m), F.lit(1.0)).when(ctx, F.lit(0.75)).otherwise(F.lit(base))
            else:
                score = F.when(ctx, F.lit(0.75)).otherwise(F.lit(float(base)))
            return F.struct(F.lit(entity).alias("entity_type"), start.alias("start"),
                            (start + F.length(m)).alias("end"), score.alias("score"))
        spans.append(F.transform(matches, _two_arg(mk)))
    out = df.select(*([id_col] if id_col else []), F.explode(F.concat(*spans)).alias("span")) \
        .select(*([id_col] if id_col else []), "span.*")
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return out


def _two_arg(f):
    def g(m, i):
        return f(m, i)
    return g


def pii_report(df: DataFrame, text_col: str, by: list[str] | None = None,
               threshold: float = P.PII_CONFIDENCE_THRESHOLD) -> DataFrame:
    """Rows with at least one hit and total hits per entity type (optionally per ``by``).

    Per-row maps are exploded and aggregated with a partial (map-side) aggregate, so the
    shuffle carries one row per (group, entity type) per task.
    """
    by = by or []
    r = P.redact_frame(df.select(*by, text_col), text_col, "_redacted", threshold=threshold)
    e = r.select(*by, F.explode("pii_entities").alias("entity_type", "v"))
    return e.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("rows_with"),
                                             F.sum("v").cast("bigint").alias("hits"))
