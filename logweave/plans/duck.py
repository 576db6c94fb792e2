"""DuckDB SQL builders for the oracles (RE2 regexes, JSON functions, list lambdas).

These only generate oracle SQL text for the comparison harness; no engine logic lives here.
RE2 has no (?U) and no look-behind, so oracles run over ASCII rows.
"""

from __future__ import annotations

from ..functions import normalize as N
from ..functions import pii as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def jpath(key: str) -> str:
    return q("$." + key if key.isidentifier() else f'$."{key}"')


def jtruthy(j: str, key: str) -> str:
    p = jpath(key)
    return (f"(CASE json_type({j}, {p}) WHEN 'VARCHAR' THEN json_extract_string({j}, {p}) <> '' "
            f"WHEN 'BIGINT' THEN CAST(json_extract_string({j}, {p}) AS DOUBLE) <> 0 "
            f"WHEN 'UBIGINT' THEN CAST(json_extract_string({j}, {p}) AS DOUBLE) <> 0 "
            f"WHEN 'DOUBLE' THEN CAST(json_extract_string({j}, {p}) AS DOUBLE) <> 0 "
            f"WHEN 'BOOLEAN' THEN CAST(json_extract_string({j}, {p}) AS BOOLEAN) "
            f"WHEN 'OBJECT' THEN json_extract_string({j}, {p}) <> '{{}}' "
            f"WHEN 'ARRAY' THEN json_extract_string({j}, {p}) <> '[]' ELSE false END)")


def jfirst(j: str, keys: list[str]) -> str:
    whens = " ".join(f"WHEN {jtruthy(j, k)} THEN json_extract_string({j}, {jpath(k)})" for k in keys)
    return f"(CASE {whens} END)"


def jfirst_key(j: str, keys: list[str]) -> str:
    whens = " ".join(f"WHEN {jtruthy(j, k)} THEN {q(k)}" for k in keys)
    return f"(CASE {whens} END)"


def is_object(j: str) -> str:
    return f"(COALESCE(json_valid({j}), false) AND json_type(CASE WHEN json_valid({j}) THEN {j} END) = 'OBJECT')"


def _obj_text(x: str) -> str:
    return f"(ltrim({x}) LIKE '{{%' AND {is_object(x)})"


def message_ctes(src: str, value: str = "value", keys=None, depth: int = 3,
                 out: str = "message", name: str = "msg") -> str:
    """CTE chain ending in ``name`` = ``src`` plus the extracted message column ``out``."""
    keys = keys or N.MESSAGE_KEYS
    parts = [f"{name}_0 AS (SELECT *, {jfirst(value, keys)} AS _m0 FROM {src})"]
    for k in range(1, depth + 1):
        prev = f"_m{k - 1}"
        guarded = f"(CASE WHEN {_obj_text(prev)} THEN {prev} END)"
        parts.append(f"{name}_{k} AS (SELECT *, {jfirst(guarded, keys)} AS _m{k} FROM {name}_{k - 1})")
    expr = f"COALESCE(_m{depth}, '')"
    for k in range(depth - 1, -1, -1):
        expr = f"(CASE WHEN _m{k} IS NULL THEN '' WHEN NOT {_obj_text(f'_m{k}')} THEN _m{k} ELSE {expr} END)"
    drop = ", ".join(f"_m{k}" for k in range(depth + 1))
    parts.append(f"{name} AS (SELECT * EXCLUDE ({drop}), {expr} AS {out} FROM {name}_{depth})")
    return ",\n".join(parts)


def service_name(j: str, prefix: str = N.CONTAINER_PREFIX) -> str:
    cn = f"json_extract_string({j}, '$.container_name')"
    clean = f"regexp_replace(regexp_replace({cn}, '^/', ''), {q('^' + prefix)}, '')"
    tag = f"json_extract_string({j}, '$.tag')"
    return (f"(CASE WHEN {jtruthy(j, 'container_name')} THEN {clean} "
            f"WHEN {jtruthy(j, 'service')} THEN json_extract_string({j}, '$.service') "
            f"WHEN {jtruthy(j, 'tag')} THEN (CASE WHEN starts_with({tag}, 'docker.') THEN substring({tag}, 8) END) END)")


def pick_ts(j: str) -> str:
    return jfirst(j, N.TIMESTAMP_KEYS)


def ts_is_string(j: str) -> str:
    whens = " ".join(f"WHEN {jtruthy(j, k)} THEN json_type({j}, {jpath(k)})" for k in N.TIMESTAMP_KEYS)
    return f"((CASE {whens} END) = 'VARCHAR')"


def parse_ts(s: str, default_year: int = 1900) -> str:
    return (f"(CASE WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?$') "
            f"OR regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') THEN TRY_CAST({s} AS TIMESTAMP) "
            f"WHEN regexp_matches({s}, '^[A-Za-z]{{3}} {{1,2}}\\d{{1,2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') "
            f"THEN try_strptime('{default_year:04d} ' || {s}, '%Y %b %d %H:%M:%S') END)")


def resolve_ts(ts: str, msg: str, as_of: str) -> str:
    t1 = f"TRY_CAST(NULLIF(regexp_extract({msg}, {q(N.MESSAGE_TS_PATTERNS[0])}, 1), '') AS TIMESTAMP)"
    t2 = f"TRY_CAST(NULLIF(regexp_extract({msg}, {q(N.MESSAGE_TS_PATTERNS[1])}, 1), '') AS TIMESTAMP)"
    return f"COALESCE({ts}, {t1}, {t2}, TIMESTAMP {q(as_of)})"


def alt(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def stack_trace(msg: str) -> str:
    return f"regexp_matches({msg}, {q('(?m)' + alt(N.STACK_TRACE_PATTERNS))})"


def http_level(msg: str) -> str:
    code = f"TRY_CAST(NULLIF(regexp_extract({msg}, {q(N.HTTP_STATUS_PATTERN)}, 1), '') AS INTEGER)"
    return (f"(CASE WHEN {code} >= 500 THEN 'ERROR' WHEN {code} >= 400 THEN 'WARN' "
            f"WHEN {code} >= 200 THEN 'INFO' WHEN {code} IS NOT NULL THEN 'DEBUG' END)")


def start_level(msg: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(upper({msg}), {q(alt(p))}) THEN {q(lv)}"
                     for lv, p in N.LEVEL_START_PATTERNS.items())
    return f"(CASE {whens} END)"


def known(level: str) -> str:
    lv = f"upper({level})"
    return (f"(CASE WHEN {lv} IN ('DEBUG','INFO','WARN','WARNING','ERROR','CRITICAL','FATAL') "
            f"THEN (CASE WHEN {lv} = 'WARNING' THEN 'WARN' ELSE {lv} END) END)")


def resolve_level(msg: str, meta_level: str = "NULL", level: str = "NULL") -> str:
    return (f"COALESCE({known(level)}, {known(meta_level)}, CASE WHEN {stack_trace(msg)} THEN 'ERROR' END, "
            f"{start_level(msg)}, {http_level(msg)}, 'INFO')")


def resolve_service(msg: str, meta_service: str = "NULL", log_type: str = "NULL",
                    service: str = "NULL") -> str:
    found = ", ".join(f"NULLIF(regexp_extract({msg}, {q('(?i)' + p)}, 1), '')" for p in N.SERVICE_PATTERNS)
    kw = " ".join("WHEN " + " OR ".join(f"contains(lower({msg}), {q(w)})" for w in words) + f" THEN {q(name)}"
                  for name, words in N.SERVICE_KEYWORDS)
    return (f"COALESCE(CASE WHEN {service} <> '' THEN {service} END, {meta_service}, {found}, "
            f"CASE WHEN {log_type} <> '' THEN {log_type} END, CASE {kw} END, 'unknown')")


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    dig = f"CAST(substring({d}, length({d}) - i, 1) AS INTEGER)"
    return (f"(length({d}) > 0 AND list_sum(list_transform(range(length({d})), lambda i: "
            f"CASE WHEN i % 2 = 1 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) "
            f"ELSE {dig} END)) % 10 = 0)")


def pii_ctes(src: str, text: str, name: str = "pii") -> str:
    """CTE chain ending in ``name`` = ``src`` plus ``redacted``, ``n_ip``, ``n_uuid``,
    ``n_host``, ``n_email``, ``n_card``, ``kernel``.  The recogniser phase is limited to e-mail
    and Luhn-valid cards (what RE2 can express on the ASCII fixtures)."""
    m = P._MARK
    hp = P._host_pattern(P.CLOUD_DOMAINS)
    email = P.RECOGNISERS[0][1]
    card = [r for r in P.RECOGNISERS if r[0] == "CREDIT_CARD"][0][1]
    ip = q(P.IP_PORT_PATTERN)
    uu = q(P.UUID_PATTERN)
    return ",\n".join([
        f"{name}_0 AS (SELECT *, COALESCE({text}, '') AS _s0 FROM {src})",
        f"{name}_1 AS (SELECT *, len(regexp_extract_all(_s0, {ip})) AS n_ip, "
        f"regexp_replace(regexp_replace(regexp_replace(_s0, {ip}, '[IP]{m}\\2{m}', 'g'), "
        f"'{m}:[0-9]{{1,5}}{m}', ':[PORT]', 'g'), '{m}{m}', '', 'g') AS _s1 FROM {name}_0)",
        f"{name}_2 AS (SELECT *, len(regexp_extract_all(_s1, {uu})) AS n_uuid, "
        f"regexp_replace(_s1, {uu}, '[UUID]', 'g') AS _s2 FROM {name}_1)",
        f"{name}_3 AS (SELECT *, len(regexp_extract_all(_s2, {q(hp)})) AS n_host, "
        f"regexp_replace(_s2, {q(hp)}, '[CLOUD_HOST]', 'g') AS _s3 FROM {name}_2)",
        f"{name}_4 AS (SELECT *, regexp_matches(_s3, {q('(?i)' + '|'.join(P.KERNEL_LOG_INDICATORS))}) AS kernel, "
        f"len(regexp_extract_all(_s3, {q(email)})) AS _ne, regexp_replace(_s3, {q(email)}, '[EMAIL]', 'g') AS _s4 FROM {name}_3)",
        f"{name}_5 AS (SELECT *, list_filter(regexp_extract_all(_s4, {q(card)}), lambda c: {luhn('c')}) AS _cards FROM {name}_4)",
        f"{name} AS (SELECT * EXCLUDE (_s0, _s1, _s2, _s4, _cards, _ne, _s3), "
        f"CASE WHEN kernel THEN _s3 ELSE list_reduce(list_prepend(_s4, _cards), lambda acc, c: replace(acc, c, '[CREDIT_CARD]')) END AS redacted, "
        f"CASE WHEN kernel THEN 0 ELSE _ne END AS n_email, CASE WHEN kernel THEN 0 ELSE len(_cards) END AS n_card "
        f"FROM {name}_5)",
    ])
