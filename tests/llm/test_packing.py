import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import packing

SCHEMA = "doc_id long, text string, piece string, ids int"


def library():
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    return tok


TEXTS = [None, "", " \n\t ", "Hello World, it's 2024!", "ÜBER straße ΣΊΣΥΦΟΣ İstanbul été ́x",
         "no break space\x1cunit", "don't'll 've'm", "日本語テキスト 🙂🙂", "x" * 5000,
         "<|endoftext|> a <|startoftext|>", "word " * 9000, "a\x0bb\x0cc\rd"]


def test_ids_are_the_librarys():
    tok, own = library(), packing.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        for text in TEXTS:
            ids = np.frombuffer(own.ids((text or "").encode()), dtype="<u4").tolist()
            assert ids == tok.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    own = packing.Tokenizer.of(public_tokenizers.path("word_bpe_49k.json"))
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(own.ids(text.encode()), dtype="<u4").tolist() == \
        own.library.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, limit):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            best = min(fit, key=lambda b: bins[b])
            bins[best] -= n
        else:
            bins.append(limit - n)
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=120))
def test_segment_tree_packs_as_plain_best_fit(lengths):
    seq, offset, used = packing.best_fit(np.array(lengths, dtype=np.int64), 37)
    room = [37] * used
    for s, n in zip(seq, lengths):
        room[s] -= n
    assert sorted(room) == plain_best_fit(lengths, 37)
    for s in range(used):
        spans = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if seq[i] == s)
        at = 0
        for o, n in spans:
            assert o == at
            at += n


def test_pieces_and_sequences(spark):
    rng = random.Random(5)
    rows = list(enumerate(TEXTS)) + [(100 + i, "tok " * rng.randrange(1, 300)) for i in range(120)]
    rows += [rows[3], rows[3], (None, "no id")]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], SCHEMA).repartition(3)
    pieces = packing.pack(docs, keep_ids=True, group_rows=40).cache()
    tok = library()
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=str)
    want = sorted(((i, p, 2048 * p, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
                   for i, ids in want for p in range(-(-len(ids) // 2048)) for part in [ids[2048 * p:2048 * p + 2048]]), key=str)
    got = pieces.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, list(r.ids)))
    joined = {r.sequence_id: list(r.ids) for r in packing.sequences(pieces).collect()}
    for s, parts in by.items():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n, _ in parts) <= 2048
        assert joined[s] == [x for _, _, ids in parts for x in ids]


def test_near_the_lower_bound_and_empty(spark):
    docs = spark.createDataFrame([(i, "tok " * (i % 700), "p", 1) for i in range(2000)], SCHEMA)
    pieces = packing.pack(docs).collect()
    bound = -(-sum(r.length for r in pieces) // 2048)
    assert len({r.sequence_id for r in pieces}) <= bound + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
