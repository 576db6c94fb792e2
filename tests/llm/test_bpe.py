import hashlib
import random

import numpy as np
import pytest
import tiktoken  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import bpe

SCHEMA = "doc_id long, text string, ids string, key int"
ODD = ["", " ", "\n\n", "a\n\nb", "a  b", "it's we'll 'lx x'", "\t\t x  ", "naïve café 日本語 🙂 x", "a\x1cb \x1c c",
       "no break  space　　x", "1234 5,6.7 --- %%%\r\n\r\nend "]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(bpe.default_ranks())


def check(codec, text):
    want = codec.library.encode_ordinary(text)
    assert codec.ids(text).tolist() == want
    assert codec.digest(text) == bpe.digest_of(len(want), ",".join(map(str, want)), text.encode())


def test_words_apart_encode_as_the_whole(codec):
    for text in ODD:
        check(codec, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' ls\n\t\r1.é日 \x1c\x85")), max_size=30))
def test_words_apart_on_any_text(text):
    check(bpe.Codec.of(bpe.default_ranks()), text)


def texts():
    rng = random.Random(2)
    parts = ["the ", "of\n", "don't", "  ", "x", "12", "é", "日本", "'ll", "\n\n\n", ".", " —", "\t"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(10, 400))) for _ in range(40)]
    return [None, *ODD, *made, "a" * 900, " " * 700, "ab " * 300 + "z" * 333 + " tail" * 50]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 64), (1 << 15, 1 << 10)])
def test_chunks_give_the_ids_of_the_whole_text(spark, codec, chunk, overlap):
    rows = list(enumerate(texts()))
    rows += [rows[20], (None, rows[21][1])]
    docs = spark.createDataFrame([(i, t, "i", 1) for i, t in rows], SCHEMA).repartition(3)
    want = sorted(((i, codec.library.encode_ordinary(t or "")) for i, t in rows), key=str)
    coded = bpe.encode(docs, chunk=chunk, overlap=overlap)
    got = [(r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in coded.collect()]
    assert sorted(got, key=str) == want
    raw = sorted(((r.doc_id, bytes(r.raw)) for r in bpe.decode(coded).collect()), key=str)
    assert raw == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    digests = sorted(map(tuple, bpe.digests(docs, chunk=chunk, overlap=overlap).collect()), key=str)
    assert digests == sorted(((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                               hashlib.sha256(codec.library.decode_bytes(ids)).hexdigest()) for i, ids in want), key=str)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).collect() == []
