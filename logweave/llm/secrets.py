"""Secret scanning with one combined deterministic automaton (op 6).

All rules are compiled together, by subset construction and minimisation, into one transition
array.  The array is built from the rules read backwards and runs once over a text's bytes from
its end: in that one pass it reports every byte where some rule has a match beginning.  A match
is then the leftmost such byte of a rule not yet passed, up to the longest match from there,
and the rule goes on behind it.  That is leftmost, non-overlapping search of each kind by itself.

A rule has a head and a body; matches whose body is too short are dropped after they were
found, so their text is used up all the same.

Defined results: null text counts as empty (no spans); very long texts take one pass, and a
stretch where a rule could begin at every byte is kept as its two ends; repeated rows and null doc_ids each keep a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from .shared import rows_of, utf8


@dataclass(frozen=True)
class Rule:
    name: str
    head: str
    body: str
    least: int  # bytes of the body
    fold: bool = False
    base: bool = False


#: A private key's text: headers and base64 up to the END line, newlines also as the escapes of a string literal.  A key
#: that is cut off runs as far as its headers and its runs of 16 and more go.
_HEADER = r"""[A-Za-z0-9+/=:,.;()@_"'\\\x20\t]"""
_WITHIN = rf"({_HEADER}|[\r\n]|-({_HEADER}|[\r\n]))*"
_CUT_OFF = rf"(\r?\n[A-Za-z]+(-[A-Za-z]+)*:\x20({_HEADER}|-{_HEADER})*)*(([\x20\t\r\n]|\\[nr])*[A-Za-z0-9+/=]{{16,}})+"
_END = r"-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?-----"

#: The three base kinds in their listed order, then the kinds the method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16, base=True),
    # Runs end where another byte stands, so runs of 24 and more are what is left of all runs.
    Rule("hex", r"", r"[0-9a-f]{24,}", 24, base=True),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?", rf"-----({_WITHIN}{_END}|{_CUT_OFF})?", 5),
    Rule("forge", r"gh[opsur]_", r"[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]+", 20),
    Rule("cloud", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("pay", r"[sr]k_(live|test)_", r"[A-Za-z0-9]+", 16),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 16),
    Rule("login", r"(https?|ftp|ssh|postgres|mysql|redis)://[A-Za-z0-9._%+-]+:", r"[^\x00-\x20/@:]+@", 5),
)


def _without_optional_end(node: automaton.Node) -> automaton.Node:
    parts = list(node.parts)
    while node.kind == "seq" and parts and parts[-1].kind == "rep" and parts[-1].low == 0:
        parts.pop()
    return automaton.Node(node.kind, tuple(parts), node.bytes, node.low, node.high)


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [automaton.parse(r.head, r.fold) for r in rules]
        bodies = [automaton.parse(r.body, r.fold) for r in rules]
        joined = [automaton.Node("seq", (h, b)) for h, b in zip(whole, bodies, strict=True)]
        # An optional ending has no say in where matches begin, and would cost many states there.
        needed = [automaton.Node("seq", (h, _without_optional_end(b))) for h, b in zip(whole, bodies, strict=True)]
        self.starts = automaton.build([automaton.backwards(n) for n in needed], anywhere=True)
        self.heads = [automaton.build([h], anywhere=False) for h in whole]
        self.ends = [automaton.build([j], anywhere=False) for j in joined]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        table, hot, state, tags = self.starts.table, self.starts.hot, self.starts.start, self.starts.tags
        # For each rule the stretches of bytes (first, last, counted from the end) where a match could begin.
        runs = [array("q") for _ in self.rules]
        for back, byte in enumerate(reversed(data), 1):
            state = table[state + byte]
            if state >= hot:
                for rule in tags[state >> 8]:
                    run = runs[rule]
                    if run and run[-1] == back - 1:
                        run[-1] = back
                    else:
                        run.append(back)
                        run.append(back)
        out, size = [], len(data)
        for rule, run in enumerate(runs):
            passed = 0
            for k in range(len(run) - 2, -1, -2):
                start, last = max(size - run[k + 1], passed), size - run[k]
                while start <= last:
                    end = passed = automaton.longest(self.ends[rule], data, start)
                    if end - automaton.longest(self.heads[rule], data, start) >= self.rules[rule].least:
                        out.append((start, rule, end))
                    start = max(end, start + 1)
        return sorted(out)


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if data.isascii():
        return spans
    place, at, count = {}, 0, 0
    for stop in sorted({p for s, _, e in spans for p in (s, e)}):
        count += len(data[at:stop].decode("utf-8", "replace"))
        at = stop
        place[stop] = count
    return [(place[s], rule, place[e]) for s, rule, e in spans]


FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) of every row: the secrets' kinds and places, by start and then rule."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    scan = scanner(rules)  # compiled once, shipped with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (data,) in rows_of([batch], "text"):
                found.append([{"kind": rules[r].name, "start": s, "end": e, "base": rules[r].base}
                              for s, r, e in code_points(data, scan.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, found {FOUND}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[kind]`` and ``n_chars`` counted anew.

    Spans of different kinds that overlap are replaced together, by the first one's kind.
    Every row stays; null text stays null.
    """
    names = docs.columns

    scan = scanner(rules)  # compiled once, shipped with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if v is None else _redacted(scan, v) for (v,) in rows_of([batch], "text")]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(kind))
    return out.select(*names)


def _redacted(scan: Scanner, text: str) -> str:
    data = text.encode("utf-8", "replace")
    spans = scan.spans(data)
    if not spans:
        return text
    out, at = [], 0
    for start, rule, end in spans:
        if start >= at:
            out += [data[at:start], f"[{scan.rules[rule].name}]".encode()]
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("found", lambda s: s["base"]), shown), ",")
    return find(docs).select(
        "doc_id", *(count(r.name) for r in RULES if r.base), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"))
