import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, row string, pair int"
ODD = [None, "", " ", "a", " lead", "trail ", "a  b   c\n x\t y ", "▁x", "x▁ y", "<0x41> <s> <unk> </s> <|endoftext|>",
       "naïve café 日本語 🙂 x", "it's we'll 'lx x'", "1234 5,6.7 --- %%%\r\n\r\nend ", "a\x00b \x00 c", "no break　 space",
       "ﬁ ① Å", "é ​ x‍", "a\x1cb \x1c c", "x" * 3000, "   " * 30, "日本語" * 200, "ab " * 900 + "z" * 333]


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*ta.default_files())


def whole(aligner, text):
    """Both libraries on the whole text, and the contract's byte tables, written anew."""
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    pieces = [aligner.b.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if aligner.b.is_byte(i) else p.encode().replace("▁".encode(), b" ") for i, p in zip(b, pieces)]
    decoder = {c: x for c, x in ta.shown_bytes().items()}
    raw_a = [bytes(decoder[c] for c in aligner.a.id_to_token(i)) for i in a]
    return a, b, raw_a, raw_b


def plain(aligner, text):
    """(a ids, b ids, groups, links) by comparing all byte ranges; None without tokens."""
    if not text:
        return None
    a, b, raw_a, raw_b = whole(aligner, text)
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    ranges = []
    for raw in (raw_a, raw_b):
        ends = np.cumsum([len(r) for r in raw])
        ranges.append([(int(e) - len(r), int(e)) for e, r in zip(ends, raw)])
    ra, rb = ranges
    shared = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, low = [], 0
    for high in shared:
        groups.append(([x for x, (s, e) in zip(a, ra) if low <= s < high], [y for y, (s, e) in zip(b, rb) if low <= s < high]))
        low = high
    of_byte = defaultdict(list)
    for j, (s, e) in enumerate(rb):
        for byte in range(s, e):
            of_byte[byte].append(j)
    links = [(a[i], b[j]) for i, (s, e) in enumerate(ra) for j in sorted({j for byte in range(s, e) for j in of_byte[byte]})]
    return a, b, groups, links


def contract(aligner, rows):
    told = [plain(aligner, t) for _, t in rows]
    counts = Counter(pair for p in told if p for pair in set(p[3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), p in zip(rows, told):
        if p is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = p
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    parts = ["the ", "of\n", "don't", "  ", "x", "12", "é", "日本", "'ll", "\n\n", ".", " —", "\t", "tion ", "Über", "ing "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(5, 300))) for _ in range(60)]


def check_ids(aligner, text):
    want = plain(aligner, text)
    got = aligner.ids(text)
    assert (got is None) == (want is None)
    if want:
        assert (got[0].tolist(), got[1].tolist()) == want[:2]


def test_word_by_word_ids_are_those_of_the_whole(aligner):
    assert aligner.by_word and ta.ranked_encoder(ta.default_files()[0])
    for text in texts():
        check_ids(aligner, text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' ls\n\t\r1.é日 \x1c\x85▁<0x>")), max_size=30))
def test_ids_of_any_text(text):
    check_ids(ta.Aligner.of(ta.default_files()), text)


def test_merges_of_another_order_are_left_to_the_library(tmp_path):
    import json

    told = json.load(open(ta.default_files()[0], encoding="utf-8"))
    told["model"]["merges"][0], told["model"]["merges"][5] = told["model"]["merges"][5], told["model"]["merges"][0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    assert ta.ranked_encoder(str(path)) is None


@pytest.mark.parametrize("broadcast", [0, ta.BROADCAST_PAIRS])
def test_query_rows_against_the_contract(spark, aligner, broadcast):
    rows = [*enumerate(texts()), (None, "the end of it"), (5, "the end of it"), (5, "the end of it")]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, ta.report(docs, broadcast_pairs=broadcast).collect()), key=str)
    assert got == contract(aligner, rows)


def test_memos_that_overflow_change_nothing(aligner, monkeypatch):
    want = [aligner.aligned(t or "")[:5] for t in texts()]
    for name in ("MEMO_WORDS", "MEMO_WINDOWS", "MEMO_CHARS", "MEMO_WINDOW_IDS"):
        monkeypatch.setattr(ta, name, 2)
    assert [aligner.aligned(t or "")[:5] for t in texts()] == want


def test_empty_table(spark):
    assert ta.report(spark.createDataFrame([], SCHEMA)).collect() == []
