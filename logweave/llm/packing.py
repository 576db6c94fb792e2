"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences (op 2).

A document's ids are its tokens and one end id.  Documents longer than a sequence are cut into
full pieces, each a sequence of its own; what is left over (at most one rest a document) is
packed best-fit decreasing: rests in falling length, each into the open sequence with the
least room that still holds it.  A segment tree over the remaining capacities finds that
sequence in logarithmic time.

Scale: ids are made once where the text is read.  Lengths and checksums, a few bytes a
document, are dealt evenly into groups of about ``GROUP_ROWS`` rows and every group is packed by
itself; the last, partly filled sequence of a group is all that grouping can cost.  A group's
size does not depend on any key of the data.

Defined results: null text counts as empty (its only id is the end id); repeated rows and null
doc_ids are packed row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, once, rows_of, utf8

SEQUENCE_TOKENS = 2048
END_ID = 0
GROUP_ROWS = 1 << 16
TOKENIZER = "word_bpe_49k.json"
#: Words remembered by a worker; longer words than this many bytes are not remembered.
MEMO_WORDS, MEMO_BYTES = 500_000, 48

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


#: Words of these characters are normalised and cut here as the library would: they are composed,
#: lower-cased one by one, and hold no white space.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def _shown_bytes() -> dict[int, str]:
    """How the vocabulary writes bytes that are no visible characters: counted on from 256."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(256 + n) for n, byte in enumerate(b for b in range(256) if b not in seen)}


class Tokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    No token of this vocabulary crosses ASCII white space, and normalisation works within a
    word, so a text's ids are its words' ids in a row.  Ids of words seen before are remembered.
    Plain Latin words go straight to the library's merges, all others through all of it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True  # special strings in a text are plain text
        self.merges = self.library.model.tokenize
        self.shown = _shown_bytes()
        self.memo: dict[bytes, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        """Ids of one word."""
        text = raw.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        ids = array("I")
        for part in _PARTS.findall(text.lower()):
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(self.shown)
            ids.extend([t.id for t in self.merges(part)])
        return ids.tobytes()

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        return once(("tokenizer", path), lambda: cls(path))

    def ids(self, text: bytes) -> bytes:
        words = text.split()  # bytes: ASCII white space only
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= MEMO_BYTES:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenised(docs: DataFrame, tokenizer: str, limit: int, keep_ids: bool) -> DataFrame:
    """One row a document: its number of ids, a checksum a piece and, if wanted, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer.of(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            lengths, sums, kept = [], [], []
            for (text,) in rows_of([batch], "text"):
                ids = tok.ids(text) + end
                lengths.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[at:at + 4 * limit]) for at in range(0, len(ids), 4 * limit)])
                kept.append(ids if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
                 pa.array(kept, pa.binary())], ["doc_id", "n_tokens", "sums", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, sums array<long>, ids binary")


class Capacities:
    """Open sequences by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.tree = bytearray(2 * self.leaves)  # 1: some open sequence below this node
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at, tree = room + self.leaves, self.tree
        while at and not tree[at]:
            tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the tightest sequence with ``need`` left."""
        at, leaves, tree = need + self.leaves, self.leaves, self.tree
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            while at and not (at < leaves and (tree[2 * at] or tree[2 * at + 1])):
                tree[at] = 0
                at >>= 1
        return room, sequence


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every length (1 to limit), packed best-fit decreasing; and how many sequences."""
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    state, used = Capacities(limit), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = state.take(need)
        room, at = found or (limit, used)
        used += not found
        sequence[i], offset[i] = at, limit - room
        if room > need:
            state.add(room - need, at)
    return sequence, offset, used


def _pack_group(limit: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "spread"], kind="stable")
        total = group["n_tokens"].to_numpy(dtype=np.int64)
        pieces = -(-total // limit)
        row = np.repeat(np.arange(len(group)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(total[row] - piece * limit, limit)
        sequence, offset, used = best_fit(length, limit)
        return pd.DataFrame({
            "doc_id": group["doc_id"].array[row], "piece": piece.astype(np.int32), "start": piece * limit,
            "length": length, "ids_crc32": np.concatenate(group["sums"].to_list()).astype(np.int64),
            "sequence_id": (int(group["deal"].iloc[0]) << 40) + sequence, "offset": offset,
            "spread": group["spread"].to_numpy()[row]})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ids`` from bytes to lists of integers."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        lists = [np.frombuffer(b, dtype="<i4") for (b,) in rows_of([batch], "ids")]
        columns = [*batch.columns[:at], pa.array(lists, pa.list_(pa.int32())), *batch.columns[at + 1:]]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE_TOKENS,
         keep_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their place; ``keep_ids`` adds ``ids array<int>``.

    Only lengths and checksums go through the packing groups; ids are joined to the pieces by row.
    """
    numbered = tokenised(docs, tokenizer or default_tokenizer(), limit, keep_ids).withColumn("spread", F.monotonically_increasing_id())
    made = materialise(numbered, "tokens")
    groups = max(1, math.ceil(made.count() / group_rows))
    dealt = made.drop("ids").withColumn("deal", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(groups)))
    pieces = dealt.groupBy("deal").applyInPandas(_pack_group(limit), PIECES + ", spread long")
    if not keep_ids:
        return pieces.drop("spread")
    cut = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    whole = pieces.join(made.select("spread", "ids"), "spread").withColumn("ids", cut).drop("spread")
    return whole.mapInArrow(_unpacked, PIECES + ", ids array<int>")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from ``pack(..., keep_ids=True)``: each sequence's ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``limit`` ids
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
