import random

import pytest
import xxhash

from logweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute(rows):
    """Plain fingerprints, all pairs, union by smallest id."""
    fps = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for gap in "\t\n\x0b\x0c\r":
            low = low.replace(gap, " ")
        words = [w for w in low.split(" ") if w]
        parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and group[i] != group[j]:
                    low = min(group[i], group[j])
                    group[i] = group[j] = low
                    changed = True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
        out.append(" ".join(words))
    return out


def rows_with_edges():
    texts = near_texts(60, 1) + [None, "", " \n", "Uno", "uno", "UNO dos", "Ünï çode Words Here now",
                                 "a b c", "A B C", "the same words " * 9000]
    rows = list(enumerate(texts, 5))
    return rows + [rows[0], rows[0], (None, texts[0]), (None, "alone without id")]


@pytest.mark.parametrize("short,block", [(64, 2048), (1, 7)])
def test_matches_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(simhash, "SHORT_POSTING", short)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = rows_with_edges()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_every_pair_within_the_bits_meets(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for bits in (0, 1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed
            if a != b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3}
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_first(docs).collect() == []


def test_keep_first_takes_smallest_id_and_one_row(spark):
    rows = [(3, "one two three four"), (2, "one two three four"), (2, "one two three four"), (9, "else"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], SCHEMA)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [2, 9, None]
