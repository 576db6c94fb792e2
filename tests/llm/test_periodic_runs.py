import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, start string, period int"


def plain_runs(words, least=24):
    """Every stretch, read off the words for every period."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k + p - i >= max(least, 3 * p):
                found.setdefault((i, k + p), p)
            i = max(k, i) + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def check(words):
    assert pr.runs_of(np.array(words, np.int32)) == plain_runs(words)


def made(rng, n, alphabet):
    """Words with repeated blocks, blocks within blocks, and single words changed."""
    out = []
    while len(out) < n:
        block = [rng.randrange(1, alphabet + 1) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            block = block * rng.randrange(1, 5) + [rng.randrange(1, alphabet + 1)]
        out += block * rng.randrange(1, 12)
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = 0
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    check(made(rng, rng.choice([23, 24, 60, 200, 700]), rng.choice([1, 2, 3, 50])))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 2), max_size=90))
def test_runs_of_two_words(words):
    check(words)


def test_fibonacci_words_and_one_word():
    a, b = [1], [1, 2]
    while len(b) < 1500:
        a, b = b, b + a
    check(b)
    check([1] * 500)
    check(list(range(300)) * 4)


@pytest.mark.parametrize("modulus", sorted(pr.COVERS))
def test_extensions_with_both_covers(modulus, monkeypatch):
    monkeypatch.setattr(pr.Cover, "of", classmethod(lambda cls, n: cls(modulus)))
    rng = random.Random(modulus)
    for alphabet in (1, 2, 4):
        words = np.array(made(rng, 400, alphabet), np.int32)
        x = np.array([rng.randrange(400) for _ in range(500)])
        y = (x + np.array([rng.randrange(1, 400) for _ in range(500)])) % 400
        got = pr.Extension(words).of(x, y)
        for i, j, g in zip(x, y, got):
            k = 0
            while max(i, j) + k < 400 and words[i + k] == words[j + k]:
                k += 1
            assert g == k


def test_pairs_in_blocks_are_those_of_the_kept_grid(monkeypatch):
    words = np.array(made(random.Random(3), 3000, 3), np.int32)
    want = pr.runs_of(words)
    monkeypatch.setattr(pr, "KEPT_WORDS", 100)
    monkeypatch.setattr(pr, "PAIR_BLOCK", 257)
    assert pr.runs_of(words) == want == plain_runs(words.tolist())


def test_words_in_slices(monkeypatch):
    raw = "  a b\x0bc\x0c\x85d  é\t\n\r e f\xa0g ".encode()
    want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", raw.decode())]
    for size in (1, 3, 1 << 22):
        monkeypatch.setattr(pr, "SLICE_BYTES", size)
        assert [w for part in pr.words_of(raw) for w in part] == want
    starts, ends = pr.word_bounds(raw)
    assert [raw[s:e] for s, e in zip(starts, ends)] == want


def contract(doc_id, text):
    """The contract read word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, original = len(words), list(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for s, length, p in runs:
        if best is None or length * best[2] > best[1] * p:
            best = s, length, p
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng = random.Random(8)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x " + "a b " * 12, "long " * 5000 + "end"]
    return out + [" ".join(map(str, made(rng, rng.randrange(1, 400), rng.choice([2, 40])))) for _ in range(150)]


def test_query_rows_against_the_contract(spark):
    rows = [*enumerate(texts()), (None, "a b " * 20), (9, "c " * 30), (9, "c " * 30)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, pr.report(docs, pr.contract_rewrite).collect()), key=str)
    assert got == sorted((contract(*r) for r in rows), key=str)
    assert pr.report(docs.limit(0)).collect() == []


def test_find_and_collapse(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 12 + "c", "s", 1), (2, None, "s", 1), (3, "no  run", "s", 1)], SCHEMA)
    assert [tuple(r) for r in pr.find(docs).collect()] == [(1, 1, 24, 2)]
    assert sorted(map(tuple, pr.collapse(docs).collect())) == [(1, "x a b c", "s", 1), (2, None, "s", 1), (3, "no  run", "s", 1)]
    assert pr.collapse(docs).schema == docs.schema
