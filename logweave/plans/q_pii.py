"""Registered queries: PII detection and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii as P
from ..operators import pii_ops as PO
from ..operators.partitioning import deal, spread
from ..sources.tables import Tables
from . import duck as D
from .registry import register

@register("P1", f"""WITH {D.pii_ctes('pii_lines', 'text')}
SELECT line_id, _s1_out AS text_redacted, n_ip AS ip_count FROM (
  SELECT line_id, n_ip, regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''), {D.q(P.IP_PORT_PATTERN)}, '[IP]{P._MARK}\\2{P._MARK}', 'g'),
    '{P._MARK}:[0-9]{{1,5}}{P._MARK}', ':[PORT]', 'g'), '{P._MARK}{P._MARK}', '', 'g') AS _s1_out FROM pii)""",
          views=("pii_lines",))
def q_p1(spark, sf_dir):
    t = Tables(spark, sf_dir).pii_lines
    s, n = P.redact_ip("text")
    return t.select("line_id", s.alias("text_redacted"), n.cast("bigint").alias("ip_count"))


# RE2 knows ASCII word characters only: letters and numbers of all scripts become an ASCII one, what else is
# not ASCII a gap, so that its word borders are those of the library's pattern.
_WORDS = r"regexp_replace(regexp_replace(text, '[\p{L}\p{Nl}\p{No}]', 'x', 'g'), '[^\x00-\x7F]', ' ', 'g')"


@register("P1_docs", f"""SELECT doc_id, CASE WHEN text IS NOT NULL
  THEN len(regexp_extract_all({_WORDS}, {D.q(P.IP_PORT_PATTERN)})) END AS ip_count FROM documents""")
def q_p1_docs(spark, sf_dir):
    """IPv4 count over whole documents."""
    return Tables(spark, sf_dir).documents.select("doc_id", P.redact_ip("text")[1].cast("bigint").alias("ip_count"))


@register("P2", f"""SELECT line_id, regexp_replace(text, {D.q(P.UUID_PATTERN)}, '[UUID]', 'g') AS text_redacted,
  len(regexp_extract_all(text, {D.q(P.UUID_PATTERN)})) AS uuid_count FROM pii_lines""", views=("pii_lines",))
def q_p2(spark, sf_dir):
    s, n = P.redact_uuid("text")
    return Tables(spark, sf_dir).pii_lines.select("line_id", s.alias("text_redacted"), n.cast("bigint").alias("uuid_count"))


_HP = P._host_pattern(P.CLOUD_DOMAINS)


@register("P3", f"""SELECT line_id, regexp_replace(text, {D.q(_HP)}, '[CLOUD_HOST]', 'g') AS text_redacted,
  len(regexp_extract_all(text, {D.q(_HP)})) AS host_count FROM pii_lines""", views=("pii_lines",))
def q_p3(spark, sf_dir):
    s, n = P.redact_hosts("text")
    return Tables(spark, sf_dir).pii_lines.select("line_id", s.alias("text_redacted"), n.cast("bigint").alias("host_count"))


@register("P4", f"""SELECT line_id, COALESCE(regexp_matches(text, {D.q('(?i)' + '|'.join(P.KERNEL_LOG_INDICATORS))}), false) AS is_kernel
FROM pii_lines""", views=("pii_lines",))
def q_p4(spark, sf_dir):
    return Tables(spark, sf_dir).pii_lines.select("line_id", P.is_kernel_log("text").alias("is_kernel"))


_P8_SQL = f"""WITH {D.pii_ctes('pii_lines', 'text')}
SELECT line_id, redacted AS text_redacted, n_ip AS ip_count, n_uuid AS uuid_count, n_host AS host_count,
  n_email AS email_count, n_card AS card_count, (n_ip + n_uuid + n_host + n_email + n_card) > 0 AS pii_redacted
FROM pii"""


def _p8(spark, sf_dir):
    t = deal(Tables(spark, sf_dir).pii_lines)
    r = P.redact_frame(t, "text", "text_redacted")
    e = F.col("pii_entities")

    def n(k):
        return F.coalesce(F.element_at(e, F.lit(k)), F.lit(0)).cast("bigint")
    return r.select("line_id", "text_redacted", n("IP_ADDRESS").alias("ip_count"),
                    n("UUID").alias("uuid_count"), n("CLOUD_HOST").alias("host_count"),
                    n("EMAIL_ADDRESS").alias("email_count"), n("CREDIT_CARD").alias("card_count"),
                    "pii_redacted")


register("P8", _P8_SQL, views=("pii_lines",))(_p8)


@register("P5", f"""WITH {D.pii_ctes('pii_lines', 'text')}
SELECT line_id, n_email AS email_count, n_card AS card_count FROM pii""", views=("pii_lines",))
def q_p5(spark, sf_dir):
    return _p8(spark, sf_dir).select("line_id", "email_count", "card_count")


@register("P7", f"""WITH {D.pii_ctes('pii_lines', 'text')}
SELECT line_id, k AS entity_type, v AS n FROM (
  SELECT line_id, unnest(['IP_ADDRESS','UUID','CLOUD_HOST','EMAIL_ADDRESS','CREDIT_CARD']) AS k,
         unnest([n_ip, n_uuid, n_host, n_email, n_card]) AS v FROM pii) WHERE v > 0""", views=("pii_lines",))
def q_p7(spark, sf_dir):
    t = deal(Tables(spark, sf_dir).pii_lines)
    r = P.redact_frame(t, "text")
    # An inner explode puts a filter on the map's size below it, which would redact every text again.
    return r.select("line_id", F.explode_outer("pii_entities").alias("entity_type", "n")) \
        .where("entity_type is not null").withColumn("n", F.col("n").cast("bigint"))


@register("P9", f"""WITH {D.pii_ctes('pii_lines', 'text')},
e AS (SELECT unnest(['IP_ADDRESS','UUID','CLOUD_HOST','EMAIL_ADDRESS','CREDIT_CARD']) AS entity_type,
             unnest([n_ip, n_uuid, n_host, n_email, n_card]) AS v FROM pii)
SELECT entity_type, COUNT(*) AS rows_with, CAST(SUM(v) AS BIGINT) AS hits FROM e WHERE v > 0 GROUP BY entity_type""",
          views=("pii_lines",))
def q_p9(spark, sf_dir):
    return PO.pii_report(Tables(spark, sf_dir).pii_lines, "text")


@register("P9_documents")
def q_p9_documents(spark, sf_dir):
    """PII inventory over the whole documents corpus (all languages; rows-only check)."""
    return PO.pii_report(spread(Tables(spark, sf_dir).documents), "text")


@register("P9_pages")
def q_p9_pages(spark, sf_dir):
    return PO.pii_report(spread(Tables(spark, sf_dir).pages), "html")


@register("P6")
def q_p6(spark, sf_dir):
    """Detection spans (type, start, end, score) over whole documents; rows-only."""
    return PO.detect_pii(spread(Tables(spark, sf_dir).documents), "text", id_col="doc_id")
