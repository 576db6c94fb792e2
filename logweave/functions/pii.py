"""PII detection and redaction (P1-P8) as column expressions.

Phases, in order: IPv4 (with optional port) -> UUID -> managed-cloud host names -> kernel-log
bypass -> recogniser phase.  Every phase is a ``regexp_replace`` plus a ``regexp_count`` on
the output of the previous phase, so the whole pipeline is one narrow projection inside
whole-stage codegen.  Checksums (Luhn for cards, mod-97 for IBAN) are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# Fixed values (must equal the reference): phase 1-3 patterns and the kernel-log markers.
IP_PORT_PATTERN = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(:\d{1,5})?\b"
UUID_PATTERN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
CLOUD_DOMAINS = ["qdrant.io", "pinecone.io", "weaviate.cloud", "openai.azure.com", "milvus.io",
                 "chroma.cloud"]
KERNEL_LOG_INDICATORS = [r"kernel:\s*\[", r"\[\s*\d+\.\d+\]", r"pid=\d+|uid=\d+|gid=\d+"]
PII_CONFIDENCE_THRESHOLD = 0.7

# Placeholders per entity type.
PLACEHOLDERS = {
    "EMAIL_ADDRESS": "[EMAIL]",
    "PHONE_NUMBER": "[PHONE]",
    "CREDIT_CARD": "[CREDIT_CARD]",
    "SSN": "[SSN]",
    "IP_ADDRESS": "[IP]",
    "US_PASSPORT": "[PASSPORT]",
    "UK_PASSPORT": "[PASSPORT]",
    "IBAN_CODE": "[IBAN]",
    "CRYPTO": "[CRYPTO]",
    "DEFAULT": "[REDACTED]",
}

# Our own recogniser table (the reference delegates to a third-party library whose scores are
# not part of it).  Scores: checksum-valid or e-mail 1.0; pattern + context word 0.75; bare
# pattern 0.4.  Context = one of the words anywhere in the text (case-insensitive).
RECOGNISERS = [
    # (entity, pattern, base score, context words, checksum)
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 1.0, [], None),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.4, [], "mod97"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.4, [], "luhn"),
    ("CRYPTO", r"\b(?:bc1[a-z0-9]{25,39}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", 0.4,
     ["wallet", "btc", "bitcoin", "crypto"], None),
    ("SSN", r"\b\d{3}[- ]\d{2}[- ]\d{4}\b", 0.4, ["ssn", "social security"], None),
    ("US_PASSPORT", r"\b[A-Z]?\d{9}\b", 0.4, ["passport"], None),
    ("PHONE_NUMBER", r"(?<![\w+])(?:\+?1[-. ]?)?(?:\(\d{3}\)\s?|\d{3}[-. ])\d{3}[-. ]\d{4}\b", 0.4,
     ["phone", "call", "tel", "mobile", "cell", "fax"], None),
]

_MARK = ""   # private-use marker, used to keep the single-pass IP:port semantics


#: Word characters of all scripts; ``\b`` alone means different things to different Java versions.
WORD = r"[\p{L}\p{Nl}\p{No}0-9_]"
BORDER = r"\b"


def between_words(pattern: str) -> str:
    r"""A pattern that begins and ends with ``\b`` and a word character, its borders spelled out."""
    return f"(?<!{WORD}){pattern.removeprefix(BORDER).removesuffix(BORDER)}(?!{WORD})"


def _host_pattern(domains: list[str]) -> str:
    alts = "|".join(d.replace(".", r"\.") for d in domains)
    return rf"(?i)[a-zA-Z0-9.-]*\.({alts})(:\d+)?"


def redact_ip(c: str | Column) -> tuple[Column, Column]:
    """``a.b.c.d:port`` -> ``[IP]:[PORT]``, ``a.b.c.d`` -> ``[IP]`` in one left-to-right
    scan (a marker carries the optional port group to a second, literal rewrite)."""
    s, pattern = col(c), between_words(IP_PORT_PATTERN)
    marked = F.regexp_replace(s, pattern, f"[IP]{_MARK}$2{_MARK}")
    out = F.regexp_replace(F.regexp_replace(marked, f"{_MARK}:[0-9]{{1,5}}{_MARK}", ":[PORT]"),
                           f"{_MARK}{_MARK}", "")
    return out, F.regexp_count(s, F.lit(pattern))


def redact_uuid(c: str | Column) -> tuple[Column, Column]:
    """P2."""
    s, pattern = col(c), between_words(UUID_PATTERN)
    return F.regexp_replace(s, pattern, "[UUID]"), F.regexp_count(s, F.lit(pattern))


def redact_hosts(c: str | Column, domains: list[str] | None = None) -> tuple[Column, Column]:
    """Managed-cloud host names (optional port) -> ``[CLOUD_HOST]``."""
    s = col(c)
    p = _host_pattern(domains or CLOUD_DOMAINS)
    return F.regexp_replace(s, p, "[CLOUD_HOST]"), F.regexp_count(s, F.lit(p))


def is_kernel_log(c: str | Column) -> Column:
    """kernel/system log markers (such rows skip the recogniser phase)."""
    s = col(c)
    return F.coalesce(s.rlike("(?i)" + "|".join(KERNEL_LOG_INDICATORS)), F.lit(False))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _mod97_ok(s: Column) -> Column:
    """IBAN check: move the first four characters to the end, letters -> 10..35, mod 97 == 1."""
    r = F.concat(F.substring(s, 5, 1 << 20), F.substring(s, 1, 4))
    chars = F.split(r, "")

    def step(acc, ch):
        d = F.ascii(ch)
        return F.when((d >= 48) & (d <= 57), (acc * 10 + (d - 48)) % 97) \
            .otherwise((acc * 100 + (d - 55)) % 97)
    return F.aggregate(chars, F.lit(0).cast("bigint"), step) == 1


def _valid(check: str | None, m: Column) -> Column:
    if check == "luhn":
        return F.call_function("luhn_check", _digits(m))
    if check == "mod97":
        return _mod97_ok(m)
    return F.lit(True)


def _accept(check, base: float, ctx: Column, threshold: float):
    # HOF lambdas must take exactly the element argument (PySpark inspects the arity).
    def f(m):
        if base >= 1.0:
            score = F.lit(1.0)
        elif check is not None:
            score = F.when(_valid(check, m), F.lit(1.0)).when(ctx, F.lit(0.75)).otherwise(F.lit(base))
        else:
            score = F.when(ctx, F.lit(0.75)).otherwise(F.lit(base))
        return score >= F.lit(threshold)
    return f


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body(var)`` once per row.

    ``transform(array(value), body)[1]``: the value is computed once and every reference inside
    ``body`` reads the variable, so chained phases stay linear in size whatever the optimizer
    does with the surrounding projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _recogniser_step(entity, pattern, base, context, check, threshold):
    repl = F.lit(PLACEHOLDERS.get(entity, PLACEHOLDERS["DEFAULT"]))

    def step(acc):
        s = acc["t"]
        ctx = s.rlike("(?i)\\b(" + "|".join(context) + ")\\b") if context else F.lit(False)
        guard = _guard(entity, s, base, check, ctx, threshold)
        cands = F.when(guard, F.regexp_extract_all(s, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))

        accept = _accept(check, base, ctx, threshold)

        def woven(found):
            """The text cut at the matches, accepted ones replaced where they stand."""
            return F.array_join(F.flatten(F.zip_with(
                F.split(s, pattern, -1), found,
                lambda piece, m: F.array(piece, F.when(m.isNull(), F.lit("")).when(accept(m), repl).otherwise(m)))), "")

        def with_found(found):
            kept = F.size(F.filter(found, accept))
            return F.struct(F.when(kept > 0, woven(found)).otherwise(s).alias("t"),
                            F.concat(acc["n"], F.array(kept)).alias("n"))
        return let(cands, with_found)
    return step


def _guard(entity: str, s: Column, base: float, check, ctx: Column, threshold: float) -> Column:
    """Cheap necessary condition for any candidate of a recogniser to be accepted, so the
    (backtracking) pattern only runs on texts that can produce a hit.  Results are unchanged:
    a candidate below the threshold without context or checksum is never kept."""
    if base >= threshold:
        return s.contains("@") if entity == "EMAIL_ADDRESS" else F.lit(True)
    if check == "luhn":
        return F.length(F.regexp_replace(s, "[^0-9]", "")) >= 13
    if check == "mod97":
        return s.rlike("[A-Z]{2}[0-9]{2}")
    if 0.75 >= threshold:
        return ctx
    return F.lit(False)


def redact(c: str | Column, threshold: float = PII_CONFIDENCE_THRESHOLD,
           domains: list[str] | None = None, recognisers=None) -> Column:
    """The full ordered pipeline P1 -> P2 -> P3 -> P4 -> P5 as one column.

    Returns ``struct(text, entities MAP<STRING,INT>, pii_redacted)``; ``entities`` holds the
    types with a positive count (P7).  Each phase reads the previous phase's text through a
    lambda variable (see ``let``).
    """
    recognisers = recognisers or RECOGNISERS
    hp = _host_pattern(domains or CLOUD_DOMAINS)

    def phase1(x):
        marked = F.regexp_replace(x, between_words(IP_PORT_PATTERN), f"[IP]{_MARK}$2{_MARK}")
        out = F.regexp_replace(F.regexp_replace(marked, f"{_MARK}:[0-9]{{1,5}}{_MARK}", ":[PORT]"),
                               f"{_MARK}{_MARK}", "")
        return F.struct(out.alias("t"), F.array(F.regexp_count(x, F.lit(between_words(IP_PORT_PATTERN)))).alias("n"))

    def phase(pattern, placeholder, guard_pattern=None, guard_literal=None):
        def f(acc):
            s = acc["t"]
            g = s.rlike(guard_pattern) if guard_pattern else (s.contains(guard_literal) if guard_literal else F.lit(True))
            return F.struct(F.when(g, F.regexp_replace(s, pattern, placeholder)).otherwise(s).alias("t"),
                            F.concat(acc["n"], F.array(F.when(g, F.regexp_count(s, F.lit(pattern))).otherwise(F.lit(0))))
                            .alias("n"))
        return f

    r = let(F.coalesce(col(c), F.lit("")), phase1)
    r = let(r, phase(between_words(UUID_PATTERN), "[UUID]", guard_literal="-"))
    dom = "|".join(d.replace(".", r"\.") for d in (domains or CLOUD_DOMAINS))
    r = let(r, phase(hp, "[CLOUD_HOST]", guard_pattern=rf"(?i)\.({dom})"))

    def after_hosts(early):
        kernel = is_kernel_log(early["t"])
        rr = F.struct(early["t"].alias("t"), F.array().cast("array<int>").alias("n"))
        for rec in recognisers:
            rr = let(rr, _recogniser_step(*rec, threshold))

        def finish(rec_out):
            names = ["IP_ADDRESS", "UUID", "CLOUD_HOST"] + [x[0] for x in recognisers]
            counts = F.when(kernel, F.concat(early["n"], F.array_repeat(F.lit(0), len(recognisers)))) \
                .otherwise(F.concat(early["n"], rec_out["n"]))
            ents = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                                                  counts.cast("array<int>")), _positive)
            text = F.when(kernel, early["t"]).otherwise(rec_out["t"])
            return F.struct(text.alias("text"), ents.alias("entities"),
                            (F.size(ents) > 0).alias("pii_redacted"))
        return let(rr, finish)
    return let(r, after_hosts)


def _positive(_, v):
    return v > 0


def redact_frame(df: DataFrame, text_col: str, out_col: str | None = None,
                 threshold: float = PII_CONFIDENCE_THRESHOLD,
                 domains: list[str] | None = None) -> DataFrame:
    """P8 on a frame: adds ``out_col`` (default ``<text_col>_redacted``), ``pii_entities`` and
    ``pii_redacted`` in one narrow projection."""
    out_col = out_col or f"{text_col}_redacted"
    r = "_pii_r"
    return df.withColumn(r, redact(text_col, threshold, domains)) \
        .withColumn(out_col, F.col(f"{r}.text")) \
        .withColumn("pii_entities", F.col(f"{r}.entities")) \
        .withColumn("pii_redacted", F.col(f"{r}.pii_redacted")).drop(r)
