"""URL rules in a sorted digest array (op 11).

A rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the
rule's; of the rules that fit, the longest (host and path together) wins.  Rules are kept in two
memory-mapped digest arrays (``digest_array``): rule hosts with the lengths of their
paths, and whole rules with their verdicts.  A URL probes the suffixes of its host in the
first and, for the hosts found, the prefixes of its path that have a rule's length in the
second; each batch of URLs is two vectorised binary searches, and stored strings are compared.
Where no rule fits, the URL is on no list and gets ``default``.

Scale: one narrow scan of the URLs without a shuffle; the rules' files go to every executor, their size
checked.  No host is a hot key.

Defined results: a null URL or one without ``://`` has an empty host and path; rules with a null
host or verdict, or a path that is neither empty nor starts with ``/``, fit nothing; a null path
is empty; of two verdicts for one rule ``block`` wins; of two equally long rules the longer
host wins; a rule with an empty host fits empty hosts and hosts that end with a dot.  Repeated rows and null
ids each keep a row; an empty table gives an empty result; no rules give every URL the default;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import digest_array
from .digest_array import DigestArray
from .shared import rows_of

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules: (host, path, verdict).  Fixed values.
CONTRACT_RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
                  ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]


def lower_host(host: F.Column) -> F.Column:
    return F.translate(host, _UPPER, _LOWER)


def parts_of(url: str) -> tuple[F.Column, F.Column]:
    """(host, path) columns of a URL column."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return lower_host(F.regexp_extract(text, "://([^/?#]*)", 1)), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


class RuleIndex:
    """Both arrays of a rule table ``rules(host, path, verdict)``."""

    def __init__(self, rules: DataFrame, **limits):
        sound = (rules.select(lower_host(F.col("host").cast("string")).alias("host"),
                              F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                              F.col("verdict").cast("string").alias("verdict"))
                 .where("host is not null and verdict is not null and (path = '' or path like '/%')"))
        one = sound.groupBy("host", "path").agg(
            F.coalesce(F.max(F.when(F.col("verdict") == BLOCK, F.lit(BLOCK))), F.max("verdict")).alias("verdict"))
        self.rules = digest_array.build(one.select(F.concat("host", "path").alias("key"),
                                                   F.col("verdict").cast("binary").alias("payload")), **limits)
        # At most as many lengths as the longest path has characters.
        lengths = one.groupBy("host").agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
        self.hosts = digest_array.build(lengths.select(
            F.col("host").alias("key"), F.array_join("lengths", ",").cast("binary").alias("payload")), **limits)


def _suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains that are no longer than a rule's host can be."""
    out, at = [], 0
    while True:
        if len(host) - at <= longest:
            out.append(host[at:])
        dot = host.find(".", at)
        if dot < 0:
            return out
        at = dot + 1


def _numbered(groups: list[list[str]]) -> tuple[list[bytes], dict[str, int]]:
    """The different strings of all groups and their numbers."""
    number = {s: i for i, s in enumerate(dict.fromkeys(s for group in groups for s in group))}
    return [s.encode() for s in number], number


def best_rules(hosts: DigestArray, rules: DigestArray, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
    """(rule, verdict) of each (host, path), None where no rule fits."""
    names = list(dict.fromkeys(h for h, _ in urls))
    domains = dict(zip(names, ([*_suffixes(h, hosts.longest)] for h in names), strict=True))
    strings, number = _numbered(list(domains.values()))
    found = hosts.find(strings)
    fits = {}
    for name, suffixes in domains.items():
        held = [(s, found[number[s]]) for s in suffixes]
        fits[name] = [(s, list(map(int, lengths.split(b",")))) for s, lengths in held if lengths is not None]
    # Longest host first; a rule's own string tells host and path apart, for hosts hold no slash.
    probes = [[s + path[:n] for s, lengths in fits[host] for n in lengths if n <= len(path)] for host, path in urls]
    strings, number = _numbered(probes)
    verdicts = rules.find(strings)
    out = []
    for row in probes:
        hits = [p for p in row if verdicts[number[p]] is not None]
        best = max(hits, key=len, default=None)  # the first of equals has the longest host
        out.append(None if best is None else (best, verdicts[number[best]].decode()))
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, **limits) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages(page_id, url)``."""
    index = RuleIndex(rules, **limits)
    hosts, known = index.hosts, index.rules
    host, path = parts_of("url")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = best_rules(hosts, known, list(rows_of([batch], "host", "path")))
            rule = pa.array([g and g[0] for g in got], pa.string())
            verdict = pa.array([g[1] if g else default for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def contract_rules(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame(CONTRACT_RULES, "host string, path string, verdict string")


def _oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in CONTRACT_RULES)
    return f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {values}),
u AS (SELECT page_id, row_number() OVER () AS row_no,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT row_no, rhost || rpath AS rule, rverdict,
               row_number() OVER (PARTITION BY row_no ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
        FROM u, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, '{ALLOW}') AS verdict
FROM u LEFT JOIN (SELECT * FROM fit WHERE place = 1) f USING (row_no)
"""


JUDGE_SQL = _oracle()
