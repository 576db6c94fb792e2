import random
import re

import pytest

from logweave.operators import multiline as ML

LINES = ["Traceback (most recent call last):", '  File "a.py", line 3', "    raise ValueError(x)",
         "ValueError: bad", "INFO:app:ok", "plain text", "ERROR:app:failed", "", "2024-01-15 10:30:45 tick",
         "   ^^^^", "WARNING:x:y", "continued detail"]


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "src string, arrival_ms long, seq long, line string")
    out = ML.assemble_multiline(df, **kw).collect()
    return sorted([(r["src"], r["first_seq"], r["message"], r["line_count"], r["aggregated"],
                    r["detected_error"]) for r in out])


def walk(rows, gap_ms=2000, max_lines=100):
    """The rules read line by line: what a line does to the buffer of its key."""
    def any_of(patterns, flags=0):
        return re.compile("|".join(f"(?:{p})" for p in patterns), flags)

    fresh, more = any_of(ML.NEW_ENTRY_PATTERNS), any_of(ML.CONTINUATION_PATTERNS)
    error, opens = any_of(ML.ERROR_INDICATORS, re.M), re.compile(ML.OPENER_START)
    out, held = [], {}

    def emit(key, lines, joined):
        text = "\n".join(line for _, _, line in lines)
        out.append((key, lines[0][1], text, len(lines), joined, joined and bool(error.search(text))))

    for key, t, q, line in sorted(rows, key=lambda r: (r[1], r[2])):
        line = line.rstrip("\n")
        if not line:
            continue
        buffer = held.get(key, [])
        trace = ML.TRACEBACK_TEXT in line
        joins = buffer and t - buffer[-1][0] <= gap_ms and not trace and (more.match(line) or not fresh.match(line))
        if not joins and buffer:
            emit(key, buffer, True)
            buffer = []
        if joins or trace or error.search(line) or opens.match(line):
            buffer = [*buffer, (t, q, line)]
        else:
            emit(key, [(t, q, line)], False)
        if joins and len(buffer) >= max_lines:
            emit(key, buffer, True)
            buffer = []
        held[key] = buffer
    for key, buffer in held.items():
        if buffer:
            emit(key, buffer, True)
    return sorted(out)


def _sim(rows, **kw):
    return walk(rows, **kw)


@pytest.mark.parametrize("seed", range(6))
def test_lines_cut_in_any_batches_give_the_same_records(seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([50, 100, 400, 2500])
        rows.append(("k", t, i, rng.choice([x for x in LINES if x])))
    got, carry, at = [], [], 0
    while at < len(rows):
        step = rng.randrange(1, 40)
        lines = carry + [r[1:] for r in rows[at:at + step]]
        at += step
        records, held = ML.assemble_lines(*map(list, zip(*lines)), max_lines=9, closed=at >= len(rows))
        got += records
        carry = lines[held:]
    assert not carry
    assert sorted(("k", r["first_seq"], r["message"], r["line_count"], r["aggregated"], r["detected_error"])
                  for r in got) == walk(rows, max_lines=9)


def test_matches_sequential_rules_random(spark):
    rng = random.Random(7)
    rows = []
    t = 0
    for i in range(3000):
        t += rng.choice([50, 100, 400, 2500])
        rows.append((f"k{rng.randrange(3)}", t, i, rng.choice(LINES)))
    assert _run(spark, rows, bucket_ms=5000) == _sim(rows)


def test_cap_at_max_lines(spark):
    # one opener followed by 250 continuation lines with small gaps, then an opener mid-way
    rows = [("a", 0, 0, "ERROR:app:boom")]
    for i in range(1, 260):
        line = "ERROR:x:again" if i == 130 else f"  detail {i}"
        rows.append(("a", i * 10, i, line))
    got = _run(spark, rows, max_lines=100, bucket_ms=700)
    assert got == _sim(rows, max_lines=100)
    assert [g[3] for g in got if g[4]] == [100, 100]   # 230..259 pass through (no opener)


def test_cap_random(spark):
    rng = random.Random(11)
    rows = []
    t = 0
    for i in range(1200):
        t += rng.choice([10, 20, 30])
        rows.append(("k", t, i, rng.choice(["  more", "ERROR:a:b", "x", "  y"])))
    assert _run(spark, rows, max_lines=7, bucket_ms=300) == _sim(rows, max_lines=7)


def test_drain_flushes_open_buffer(spark):
    rows = [("a", 0, 0, "Traceback (most recent call last):"), ("a", 10, 1, '  File "x.py", line 1')]
    got = _run(spark, rows)
    assert got == [("a", 0, 'Traceback (most recent call last):\n  File "x.py", line 1', 2, True, True)]
