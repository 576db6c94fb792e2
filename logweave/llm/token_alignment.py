"""Alignment of two tokenisations by white-space anchors (op 13).

A text is tokenised whole by two tokenizers, A (byte-level BPE over a space and the text) and B (pieces,
which adds that space itself).  Byte offsets where tokens of both end, each followed by a
token that starts with a space, are anchors: both sides have consumed the same bytes there, so
alignment never looks across.  Anchors cut the two id sequences into windows, mostly single
words, and the alignment of a window depends on its ids alone; it is computed once and
remembered by its ids.  Inside a window two pointers walk over the tokens' byte lengths: tokens
whose ranges overlap are links, and offsets where both end close a group.

Tokenising is done word by word with a memo: neither vocabulary has a token that crosses a single
space between two visible characters (A's pre-tokens end there; of B's pieces that is checked when the
model is loaded), so the ids are those of the whole text.

Scale: texts are read once; a row then holds its ids' digests and its different id pairs with
their numbers, a few bytes a link.  Document counts of pairs are a partial/final aggregate over
them.  Counts are as many as there are different pairs, a matter of the vocabularies; up to
``BROADCAST_PAIRS`` they are broadcast to the links, so a pair that all documents hold is no hot key, and
beyond that joined by pair, where AQE splits such a key.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (white
space or marks that B writes otherwise), have no tokens and zeros; repeated rows and null doc_ids each
count as a document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, once, rows_of, utf8

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MEMO_WORDS, MEMO_CHARS = 200_000, 48
MEMO_WINDOWS, MEMO_WINDOW_IDS = 200_000, 32
#: Up to this many different pairs (some 60 bytes each) their counts are broadcast.
BROADCAST_PAIRS = 1 << 20
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


def shown_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible ones as themselves, others counted on from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Bytes, byte lengths, decimal ids and leading spaces of the tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.shown = [str(i) for i in range(len(tokens))]
        self.lengths = np.array(self.sizes, np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])


def ranked_encoder(file: str) -> Callable[[list[str]], list[list[int]]] | None:
    """A faster encoder of the same vocabulary, where its ids rise in the order of its merges.

    None for vocabularies of another kind: with a normaliser, another split pattern or other ids.
    """
    import public_tokenizers
    import tiktoken

    with open(file, encoding="utf-8") as text:
        told = json.load(text)
    split, model, byte_of = told["pre_tokenizer"], told["model"], shown_bytes()
    if (told["normalizer"], split and split["type"], model["type"]) != (None, "ByteLevel", "BPE"):
        return None
    if split["add_prefix_space"] or not split.get("use_regex", True) or not byte_of.keys() <= model["vocab"].keys():
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(set(ids)):
        return None
    ranks = {bytes(byte_of[c] for c in t): model["vocab"][t] for t in [*byte_of, *merged]}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [library.encode_ordinary(t) for t in texts]


def align_window(a: list[int], b: list[int], of_a: Vocabulary, of_b: Vocabulary) -> tuple[str, int, bytes]:
    """The alignment of one window: its groups as text, their number, its links as pairs of 32-bit ids, B's first."""
    size_a, size_b, shown_a, shown_b = of_a.sizes, of_b.sizes, of_a.shown, of_b.shown
    groups, links = [], []
    i = j = 0
    x, y = a[0], b[0]
    end_a, end_b = size_a[x], size_b[y]
    text_a, text_b = shown_a[x], shown_b[y]
    while True:
        links += (y, x)
        if end_a == end_b:
            groups.append(f"{text_a}|{text_b}")
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups), len(groups), array("I", links).tobytes()
            x, y = a[i], b[j]
            end_a, end_b = end_a + size_a[x], end_b + size_b[y]
            text_a, text_b = shown_a[x], shown_b[y]
        elif end_a < end_b:
            i += 1
            x = a[i]
            end_a += size_a[x]
            text_a += "," + shown_a[x]
        else:
            j += 1
            y = b[j]
            end_b += size_b[y]
            text_b += "," + shown_b[y]


class Aligner:
    """Both tokenizers and the memos of a worker."""

    def __init__(self, file_a: str, file_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True  # special strings in a text are plain text
        ranked = ranked_encoder(file_a)
        self.spells_a = ranked is not None  # ranks of bytes: its tokens always spell the text
        self.encode_a = ranked or (lambda texts: [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte_of = shown_bytes()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.of_a = Vocabulary([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in spelled])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.of_b = Vocabulary([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                                for i, p in enumerate(pieces)])
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        # Each memo has a young and an older half: what is in use moves on, the rest is forgotten.
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.older_words: dict[str, tuple[bytes, bytes] | None] = {}
        self.windows: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}
        self.older_windows: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}

    @classmethod
    def of(cls, files: tuple[str, str]) -> Aligner:
        return once(("aligner", *files), lambda: cls(*files))

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both sides' ids of a space and each part, None where a side spells something else."""
        out = []
        bytes_a, bytes_b = self.of_a.tokens.__getitem__, self.of_b.tokens.__getitem__
        for part, a, b in zip(parts, self.encode_a([" " + p for p in parts]), self.b.encode(parts, num_threads=1), strict=True):
            raw = b" " + part.encode()
            spelled = b"".join(map(bytes_b, b)) == raw and (self.spells_a or b"".join(map(bytes_a, a)) == raw)
            out.append((array("I", a).tobytes(), array("I", b).tobytes()) if spelled else None)
        return out

    def parts(self, text: str) -> list[tuple[bytes, bytes]] | None:
        """The ids of the whole text on both sides, part by part; None where it has no tokens."""
        if not text:
            return None
        parts = _BETWEEN_WORDS.split(text) if self.by_word else [text]
        if len(self.words) > MEMO_WORDS:
            self.words, self.older_words = {}, self.words
        memo, older = self.words, self.older_words
        new = []
        for part in set(parts).difference(memo):
            if part in older:
                memo[part] = older[part]
            else:
                new.append(part)
        memo.update(zip(new, self._encode(new), strict=True))
        got = list(map(memo.__getitem__, parts))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return None if None in got else got

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of the whole text on both sides; None where it has no tokens."""
        parts = self.parts(text)
        return parts and tuple(np.frombuffer(b"".join([p[side] for p in parts]), np.uint32) for side in (0, 1))

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Numbers of the tokens behind each anchor on both sides, the text's ends included."""
        end_a, end_b = np.cumsum(self.of_a.lengths[a]), np.cumsum(self.of_b.lengths[b])
        at_a = np.flatnonzero(self.of_a.spaced[a[1:]]) + 1
        at_b = np.flatnonzero(self.of_b.spaced[b[1:]]) + 1
        stop_a, stop_b = end_a[at_a - 1], end_b[at_b - 1]  # both rising
        place = np.searchsorted(stop_b, stop_a)
        shared = place < len(stop_b)
        shared[shared] = stop_b[place[shared]] == stop_a[shared]
        return [0, *at_a[shared].tolist(), len(a)], [0, *at_b[place[shared]].tolist(), len(b)]

    def aligned(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups' digest, different pairs, their numbers)."""
        parts = self.parts(text)
        if parts is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw_a, raw_b = b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        a, b = np.frombuffer(raw_a, np.uint32), np.frombuffer(raw_b, np.uint32)
        cut_a, cut_b = self.anchors(a, b)
        if len(self.windows) > MEMO_WINDOWS:
            self.windows, self.older_windows = {}, self.windows
        memo, older = self.windows, self.older_windows
        # Parts start with a space on both sides, so each starts at an anchor; where there are no more
        # anchors than parts, the parts' ids are the windows' ids.
        keys = parts if len(cut_a) - 1 == len(parts) else [
            (raw_a[4 * i:4 * j], raw_b[4 * k:4 * m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        got = list(map(memo.get, keys))
        for at in [n for n, window in enumerate(got) if window is None]:
            key = keys[at]
            got[at] = memo.get(key) or older.get(key) or align_window(
                *(np.frombuffer(side, np.uint32).tolist() for side in key), self.of_a, self.of_b)
            if max(map(len, key)) <= 4 * MEMO_WINDOW_IDS:
                memo[key] = got[at]
        links = np.frombuffer(b"".join([w[2] for w in got]), "<i8")
        pairs, times = np.unique(links, return_counts=True)
        shown = hashlib.sha256(";".join([w[0] for w in got]).encode()).hexdigest()
        return len(a), len(b), sum([w[1] for w in got]), len(links), shown, pairs, times


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


LINK = pa.struct([("pair", pa.int64()), ("times", pa.int32())])
CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                   ("links", pa.list_(LINK))])


def align(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """One row a document: its alignment's sizes, digest and ``links(pair, times)``.

    ``pair`` is the A id times 2^32 plus the B id; ``row`` names the row.
    """
    files = files or default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(files)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a bounded number of links a batch for texts of usual length
                part = batch.slice(at, 500)
                got = [aligner.aligned(raw.decode("utf-8", "replace")) for (raw,) in rows_of([part], "text")]
                links = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([g[5] for g in got])), pa.array(np.concatenate([g[6] for g in got]), pa.int32())],
                    fields=list(LINK))
                ends = np.cumsum([0, *(len(g[5]) for g in got)]).astype(np.int32)
                sizes = [pa.array([g[k] for g in got], CODED.field(k + 2).type) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *sizes, pa.ListArray.from_arrays(ends, links)], schema=CODED)

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         utf8().alias("text"))
    return narrow.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                  "groups_sha256 string, links array<struct<pair:long,times:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents that hold a pair linked; best: no pair of its A id has more."""
    counts = materialise(aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair")
                         .agg(F.count(F.lit(1)).alias("docs")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    return (counts.withColumn("a_id", a_id).join(most, "a_id")
            .select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def report(docs: DataFrame, files: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The contract's row of every document."""
    aligned = materialise(align(docs, files), "aligned")
    counts = materialise(pair_counts(aligned), "pair-scores")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    sums = (links.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("docs")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return (aligned.drop("links").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
