"""Normalisation of raw log records (N1-N10, N12) as column expressions.

The raw record is a JSON object string.  It is parsed once into a VARIANT and every probe
(``message``, ``level``, ``@timestamp`` ...) is a ``try_variant_get`` on that value, so a
record is parsed once per row, inside codegen, with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col
from .levels import KNOWN_LEVELS

# Fixed values (must equal the reference): probe order of message keys in the normaliser
# and in the multi-line assembler, of timestamp keys, and the container-name prefix.
MESSAGE_KEYS = ["message", "log", "msg", "text"]
ASSEMBLER_LINE_KEYS = ["log", "message", "msg", "text"]
TIMESTAMP_KEYS = ["@timestamp", "timestamp", "time", "date"]
CONTAINER_PREFIX = "ai-log-"

# Level patterns matched at the start of the upper-cased message, per level.
LEVEL_START_PATTERNS = {
    "ERROR": [r"^(ERROR|CRITICAL|FATAL):", r"^\[(ERROR|CRITICAL|FATAL)\]",
              r"^(ERROR|CRITICAL|FATAL)\s+-\s+",
              r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\w]*(ERROR|CRITICAL|FATAL)\b"],
    "WARN": [r"^(WARN|WARNING):", r"^\[(WARN|WARNING)\]", r"^(WARN|WARNING)\s+-\s+",
             r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\w]*(WARN|WARNING)\b"],
    "INFO": [r"^(INFO|INFORMATION):", r"^\[(INFO|INFORMATION)\]", r"^(INFO)\s+-\s+",
             r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\w]*(INFO)\b"],
    "DEBUG": [r"^(DEBUG|TRACE):", r"^\[(DEBUG|TRACE)\]", r"^(DEBUG)\s+-\s+",
              r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\w]*(DEBUG)\b"],
}
# (The reference also lists "LEVEL:\s" variants; each is implied by the "LEVEL:" pattern.)

# Stack-trace indicators (searched anywhere; ^ is per line).
STACK_TRACE_PATTERNS = [
    r"Traceback \(most recent call last\):",
    r"^\s+File \"[^\"]+\", line \d+",
    r"^[A-Za-z_][A-Za-z0-9_.]*Error:",
    r"^[A-Za-z_][A-Za-z0-9_.]*Exception:",
    r"The above exception was the direct cause",
    r"During handling of the above exception",
    r"raise \w+Error\(",
    r"raise \w+Exception\(",
]
HTTP_STATUS_PATTERN = r'HTTP/[\d.]+"\s+(\d{3})'
SERVICE_PATTERNS = [r"service[=:]\s*([^\s,]+)", r"app[=:]\s*([^\s,]+)",
                    r"component[=:]\s*([^\s,]+)"]
SERVICE_KEYWORDS = [("nginx", ["nginx"]), ("postgres", ["postgres", "database"]),
                    ("kafka", ["kafka"])]
MESSAGE_TS_PATTERNS = [r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"]

# Java regex: (?U) makes \d \w \s \b Unicode-aware like Python's str patterns.
U = "(?U)"


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


STACK_TRACE_RE = U + "(?m)" + alternation(STACK_TRACE_PATTERNS)


def parse_record(raw: str | Column) -> Column:
    """Raw JSON text -> VARIANT (NULL when the text is not valid JSON)."""
    return F.try_parse_json(col(raw))


def _path(key: str) -> str:
    return "$." + key if key.isidentifier() else f"$['{key}']"


def vget(v: Column, key: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, _path(key), typ)


def vtype(v: Column, key: str) -> Column:
    """JSON type of a field: OBJECT, ARRAY, STRING, BIGINT, DOUBLE, BOOLEAN, VOID or NULL."""
    sub = F.try_variant_get(v, _path(key), "variant")
    # "DECIMAL(2,1)" / "OBJECT<...>" / "STRING" -> leading type word (no regex)
    return F.when(sub.isNotNull(), F.substring_index(F.substring_index(F.schema_of_variant(sub), "<", 1), "(", 1))


def truthy(c: Column) -> Column:
    """Python truthiness of a string probe: present and not empty."""
    return c.isNotNull() & (c != "")


NUMERIC_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"]


def field_truthy(v: Column, key: str) -> Column:
    """Python truthiness of a JSON field: non-empty string, non-zero number, true,
    non-empty object/array; missing and null are false."""
    t = vtype(v, key)
    s = vget(v, key)
    return (F.when(t == "STRING", s != "")
            .when(t.isin(NUMERIC_TYPES), vget(v, key, "double") != 0)
            .when(t == "BOOLEAN", vget(v, key, "boolean"))
            .when(t.isin("OBJECT", "ARRAY"), ~s.isin("{}", "[]"))
            .otherwise(F.lit(False)))


def first_truthy_key(v: Column, keys: list[str]) -> Column:
    """Name of the first key whose value is truthy (NULL when none)."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(field_truthy(v, k), F.lit(k)).otherwise(out)
    return out


def first_truthy(v: Column, keys: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(field_truthy(v, k), vget(v, k)).otherwise(out)
    return out


def shown_number(d: Column) -> Column:
    """A double as the message shows it: shortest digits, a fraction always, exponents (two
    digits at least) only below 1e-4 and from 1e16."""
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    power = F.regexp_replace(F.regexp_replace(power, r"E(\d)", "e+$1"), "E-", "e-")
    return F.when((d == 0) | F.abs(d).between(1e-4, 9.999999999999999e15), plain).otherwise(power)


def shown_text(text: Column, kind: Column, number: Column) -> Column:
    """Text of a message field: strings as they are, fractional numbers and booleans as shown."""
    return (F.when(kind == "BOOLEAN", F.initcap(text))
            .when(kind.isin("DOUBLE", "FLOAT", "DECIMAL"), shown_number(number)).otherwise(text))


def first_message(v: Column, keys: list[str]) -> Column:
    """Text of the first truthy message field."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(field_truthy(v, k), shown_text(vget(v, k), vtype(v, k), vget(v, k, "double"))).otherwise(out)
    return out


def _is_json_object_text(c: Column) -> Column:
    nested = F.try_parse_json(c)
    return F.coalesce(F.ltrim(c, F.lit(" \t\n\r\x0b\x0c")).startswith("{") & nested.isNotNull() &
                      F.schema_of_variant(F.coalesce(nested, F.parse_json(F.lit("0")))).startswith("OBJECT"),
                      F.lit(False))


def unnested_message(first: Column, keys: list[str] | None = None) -> Column:
    """N1 given the first-level text: a JSON-object string is searched again, as deep as it goes
    (the first present key wins; an object without a message key gives "").

    A level inside another doubles the backslashes before its quotes, so a text of n characters
    holds at most log2(n) + 2 levels; that many steps lose none.
    """
    keys = keys or MESSAGE_KEYS
    levels = F.sequence(F.lit(1), (F.floor(F.log2(F.length(first))) + 2).cast("int"))

    def step(text: Column, _: Column) -> Column:
        return F.when(_is_json_object_text(text), F.coalesce(first_message(F.try_parse_json(text), keys), F.lit(""))) \
            .otherwise(text)

    return F.when(first.isNull(), F.lit("")) \
        .when(_is_json_object_text(first), F.aggregate(levels, first, step)).otherwise(first)


def with_message_from(df, first_col: str, out_col: str = "message", keys: list[str] | None = None):
    """N1 over a column that holds the first-level text, which is dropped."""
    return df.withColumn(out_col, unnested_message(F.col(first_col), keys)).drop(first_col)


def with_message(df, value_col: str = "value", out_col: str = "message", keys: list[str] | None = None):
    """First truthy of message/log/msg/text, nested JSON objects searched again."""
    df = df.withColumn("_m0", first_message(parse_record(value_col), keys or MESSAGE_KEYS))
    return with_message_from(df, "_m0", out_col, keys)


def extract_service_name(raw: str | Column, prefix: str = CONTAINER_PREFIX) -> Column:
    """container_name (leading '/' and ``prefix`` stripped), else service, else the
    remainder of a ``docker.`` tag, else NULL."""
    v = parse_record(raw)
    cn = vget(v, "container_name")
    cn_clean = F.regexp_replace(F.regexp_replace(cn, "^/", ""), "^" + prefix.replace(".", r"\."), "")
    svc = vget(v, "service")
    tag = vget(v, "tag")
    from_tag = F.when(tag.startswith("docker."), F.substring(tag, 8, 1 << 30))
    return F.when(field_truthy(v, "container_name"), cn_clean) \
        .when(field_truthy(v, "service"), svc) \
        .when(field_truthy(v, "tag"), from_tag).otherwise(F.lit(None).cast("string"))


def pick_timestamp(raw: str | Column) -> Column:
    """First truthy of @timestamp, timestamp, time, date, as text."""
    return first_truthy(parse_record(raw), TIMESTAMP_KEYS)


def timestamp_is_string(raw: str | Column) -> Column:
    """Whether the picked timestamp is a JSON string; numbers (epochs) parse to NULL."""
    v = parse_record(raw)
    out = F.lit(None).cast("string")
    for k in reversed(TIMESTAMP_KEYS):
        out = F.when(field_truthy(v, k), vtype(v, k)).otherwise(out)
    return out == "STRING"


def with_timestamp_field(df, value_col: str = "value", out_col: str = "_ts"):
    """N3 + N4 staged: pick the first truthy timestamp key once, then parse its value when it
    is a JSON string (numbers such as epochs give NULL, B5)."""
    v = parse_record(value_col)
    df = df.withColumn("_tsk", first_truthy_key(v, TIMESTAMP_KEYS))
    key = F.col("_tsk")
    text = F.lit(None).cast("string")
    typ = F.lit(None).cast("string")
    for k in TIMESTAMP_KEYS:
        text = F.when(key == k, vget(v, k)).otherwise(text)
        typ = F.when(key == k, vtype(v, k)).otherwise(typ)
    df = df.withColumn("_tst", text).withColumn("_tsy", typ)
    return df.withColumn(out_col, F.when(F.col("_tsy") == "STRING", parse_timestamp(F.col("_tst")))) \
        .drop("_tsk", "_tst", "_tsy")


def parse_timestamp(c: str | Column, default_year: int = 1900) -> Column:
    """The four accepted formats, anchored so that 'Z', offsets or epochs give NULL.

    %Y-%m-%dT%H:%M:%S.%f | %Y-%m-%dT%H:%M:%S | %Y-%m-%d %H:%M:%S | %b %d %H:%M:%S (year-less;
    Python gives 1900, ``default_year`` overrides).
    """
    s = col(c)
    # Fields but the year may have one digit; white space in a format stands for any amount.
    iso = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$")
    spaced = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$")
    syslog = s.rlike(r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$")
    single = F.regexp_replace(s, r"\s+", " ")
    syslog_ts = F.try_to_timestamp(
        F.concat(F.lit(f"{default_year:04d} "), F.initcap(single)), F.lit("yyyy MMM d H:m:s"))
    return F.when(iso | spaced, single.try_cast("timestamp_ntz")) \
        .when(syslog, syslog_ts.cast("timestamp_ntz"))


def resolve_timestamp(ts: Column, message: str | Column, as_of) -> Column:
    """Parsed timestamp, else the first ISO ('T' form, then space form) timestamp found in
    the message, else ``as_of`` (a Column such as ``current_timestamp()`` or a literal)."""
    msg = col(message)
    t_form = F.nullif(F.regexp_extract(msg, MESSAGE_TS_PATTERNS[0], 1), F.lit("")).try_cast("timestamp_ntz")
    s_form = F.nullif(F.regexp_extract(msg, MESSAGE_TS_PATTERNS[1], 1), F.lit("")).try_cast("timestamp_ntz")
    return F.coalesce(ts, t_form, s_form, as_of.cast("timestamp_ntz"))


def is_stack_trace(message: str | Column) -> Column:
    """N7."""
    return col(message).rlike(STACK_TRACE_RE)


def level_from_http(message: str | Column) -> Column:
    """HTTP status after a request line -> level (>=500 ERROR, >=400 WARN, >=200 INFO,
    else DEBUG); NULL without a status."""
    code = F.nullif(F.regexp_extract(col(message), U + HTTP_STATUS_PATTERN, 1), F.lit("")).cast("int")
    return F.when(code >= 500, "ERROR").when(code >= 400, "WARN").when(code >= 200, "INFO") \
        .when(code.isNotNull(), "DEBUG")


def level_from_start(message: str | Column) -> Column:
    """Start-of-message patterns on the upper-cased message (levels are mutually exclusive)."""
    up = F.upper(col(message))
    out = F.lit(None).cast("string")
    for lv in reversed(list(LEVEL_START_PATTERNS)):
        out = F.when(up.rlike(U + alternation(LEVEL_START_PATTERNS[lv])), F.lit(lv)).otherwise(out)
    return out


def _known(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up.isin(KNOWN_LEVELS), F.when(up == "WARNING", "WARN").otherwise(up))


def resolve_level(message: str | Column, metadata: Column | None = None,
                  level: Column | None = None) -> Column:
    """Explicit -> metadata['level'] -> stack trace => ERROR -> start patterns -> HTTP
    status -> INFO.  Explicit CRITICAL/FATAL stay as they are (B7)."""
    msg = col(message)
    explicit = _known(level) if level is not None else F.lit(None).cast("string")
    meta = _known(F.element_at(metadata, F.lit("level"))) if metadata is not None \
        else F.lit(None).cast("string")
    return F.coalesce(explicit, meta, F.when(is_stack_trace(msg), F.lit("ERROR")),
                      level_from_start(msg), level_from_http(msg), F.lit("INFO"))


def resolve_service(message: str | Column, metadata: Column | None = None,
                    log_type: Column | None = None, service: Column | None = None) -> Column:
    """Given -> metadata['service'] (present, even if empty) -> service=/app=/component=
    in the message (case-insensitive, first pattern that matches) -> log_type -> keyword ->
    'unknown'."""
    msg = col(message)
    given = F.when(truthy(service), service) if service is not None else F.lit(None).cast("string")
    meta = F.element_at(metadata, F.lit("service")) if metadata is not None else F.lit(None).cast("string")
    found = [F.nullif(F.regexp_extract(msg, U + "(?i)" + p, 1), F.lit("")) for p in SERVICE_PATTERNS]
    lt = F.when(truthy(log_type), log_type) if log_type is not None else F.lit(None).cast("string")
    low = F.lower(msg)
    kw = F.lit(None).cast("string")
    for name, words in reversed(SERVICE_KEYWORDS):
        cond = None
        for w in words:
            cond = low.contains(w) if cond is None else (cond | low.contains(w))
        kw = F.when(cond, F.lit(name)).otherwise(kw)
    return F.coalesce(given, meta, *found, lt, kw, F.lit("unknown"))


def merge_metadata(metadata: Column, level: Column, service: Column, log_type: Column) -> Column:
    """Input map plus extracted_level, extracted_service and log_type (default
    'unknown'); the new keys overwrite existing ones."""
    new_keys = ["extracted_level", "extracted_service", "log_type"]
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")),
                        lambda k, _: ~k.isin(new_keys))
    new = F.create_map(F.lit("extracted_level"), level, F.lit("extracted_service"), service,
                       F.lit("log_type"), F.coalesce(log_type, F.lit("unknown")))
    return F.map_concat(base, new)


def truncate(c: str | Column, n: int) -> Column:
    """Display truncation to the first ``n`` characters."""
    return F.substring(col(c), 1, n)
