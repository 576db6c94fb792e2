"""Byte-level BPE by overlapping chunks, and decoding (op 9).

Long texts are cut into chunks that overlap.  Chunks are pre-tokenised in parallel, each from
its own first character, so a chunk may start inside a pre-token.  The split pattern only ever
looks ahead, hence once two neighbouring scans share a pre-token boundary they agree from there
on: the first shared boundary in the overlap is where the texts are stitched.  (Only boundaries
after a visible character count: the pattern's look-ahead treats white space at the end of a
text differently.)  The pieces between stitches are encoded and a document's ids put together
in order.  Neighbours without a shared boundary, say in one endless word, are joined and
encoded as one piece, so the result is always that of the whole text.  Texts no longer than a
chunk are encoded where they are read, without a shuffle.

Inside a piece, words are encoded once and remembered: cutting before a single space between
two visible characters never splits a pre-token.

Decoding concatenates the raw bytes of the ids.

Defined results: null text counts as empty (no ids, empty bytes); repeated rows and null
doc_ids each keep a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, once, rows_of, utf8

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: A boundary this close to a chunk's end may still depend on the text that follows.
LOOK_AHEAD = 4
MEMO_WORDS, MEMO_CHARS = 250_000, 48

_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Codec:
    """Encoder and decoder over one rank file; one for each worker and file."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                         special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.shown: dict[str, tuple[int, str, bytes]] = {}

    @classmethod
    def of(cls, ranks: str) -> Codec:
        return once(("codec", ranks), lambda: cls(ranks))

    def _raw_ids(self, text: str) -> list[int]:
        return self.library.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, its words encoded once each."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        first, *rest = _BETWEEN_WORDS.split(text)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = [np.array(self._raw_ids(first), dtype="<u4").tobytes()]
        for word in rest:
            ids = memo.get(word)
            if ids is None:
                ids = np.array(self._raw_ids(" " + word), dtype="<u4").tobytes()
                if len(word) <= MEMO_CHARS:
                    memo[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())

    def _show(self, text: str) -> tuple[int, str, bytes]:
        ids = self._raw_ids(text)
        return len(ids), ",".join(map(str, ids)), self.library.decode_bytes(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, ids_sha256, decoded_sha256); ids of a word are shown and decoded once."""
        if not text:
            return digest_of(0, "", b"")
        first, *rest = _BETWEEN_WORDS.split(text)
        memo = self.shown
        if len(memo) > MEMO_WORDS:
            memo.clear()
        try:
            got = [memo[w] for w in rest]
        except KeyError:
            for w in rest:
                if w not in memo:
                    memo[w] = self._show(" " + w)
            got = [memo[w] for w in rest]
            for w in rest:
                if len(w) > MEMO_CHARS:
                    memo.pop(w, None)
        got.insert(0, self._show(first))
        return digest_of(sum([g[0] for g in got]), ",".join([g[1] for g in got]), b"".join([g[2] for g in got]))

    def boundaries(self, text: str, start: int, stop: int) -> list[int]:
        """Where pre-tokens start in ``text[start:stop]`` after a visible character."""
        return [m.start() for m in self.pattern.finditer(text)
                if start <= m.start() < stop and m.start() and not text[m.start() - 1].isspace()]


def digest_of(n_tokens: int, shown: str, raw: bytes) -> tuple[int, str, str]:
    return n_tokens, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"),
                       F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, doc_id, no, last, text): overlapping chunks; ``key`` names the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()),
                            ("last", pa.bool_()), ("text", pa.string())])
        for key, doc_id, raw in rows_of(batches, "key", "doc_id", "text"):
            text = raw.decode("utf-8", "replace")
            count = -(-len(text) // chunk)
            for no in range(count):
                row = [[key], [doc_id], [no], [no == count - 1], [text[no * chunk:(no + 1) * chunk + overlap]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    return keyed.mapInArrow(run, "key long, doc_id long, no int, last boolean, text string")


def _stitches(chunks: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """(key, no, begin, stop, segment) of every chunk.

    ``begin`` and ``stop`` are the stitches with the neighbours (stop null: none found);
    chunks that could not be stitched share a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            heads, tails = [], []
            for no, last, text in rows_of([batch], "no", "last", "text"):
                whole = codec.boundaries(text, 0, len(text) - (0 if last else LOOK_AHEAD))
                heads.append([p for p in whole if p < overlap - LOOK_AHEAD] if no else [])
                tails.append([] if last else [p - chunk for p in whole if p >= chunk])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("no"), batch.column("last"), pa.array(heads, ints),
                 pa.array(tails, ints)], ["key", "no", "last", "head", "tail"])

    seen = chunks.mapInArrow(run, "key long, no int, last boolean, head array<int>, tail array<int>")
    order = Window.partitionBy("key").orderBy("no")  # a text of 2 GB has some 65,000 chunks
    met = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    return (seen.withColumn("stop", met)
            .withColumn("begin", F.lag("stop").over(order))
            .withColumn("segment", F.sum(F.when(F.col("begin").isNull(), 0).otherwise(1)).over(order))
            .select("key", "no", "begin", "stop", "segment"))


def _encode_segment(ranks: str, chunk: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        texts, end = part["text"].tolist(), part["stop"].iloc[-1]
        body = "".join(t[:chunk] for t in texts[:-1])
        body += texts[-1] if part["last"].iloc[-1] else texts[-1][:chunk + int(end)]
        begin = part["begin"].iloc[0]
        ids = Codec.of(ranks).ids(body[0 if pd.isna(begin) else int(begin):])
        return pd.DataFrame({"key": part["key"].iloc[:1], "doc_id": part["doc_id"].iloc[:1],
                             "segment": part["segment"].iloc[:1], "ids": [ids.tobytes()]})

    return run


def _long_ids(docs: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids binary) of texts longer than a chunk, put together from their segments."""
    chunks = materialise(_chunks(docs, chunk, overlap), "chunks")
    placed = chunks.join(_stitches(chunks, ranks, chunk, overlap), ["key", "no"])
    parts = placed.groupBy("key", "segment").applyInPandas(
        _encode_segment(ranks, chunk), "key long, doc_id long, segment long, ids binary")
    return parts.groupBy("key").applyInPandas(_in_order, "doc_id long, ids binary")


def _in_order(parts: pd.DataFrame) -> pd.DataFrame:
    """One document's ids, about as large as its text."""
    parts = parts.sort_values("segment")
    return pd.DataFrame({"doc_id": parts["doc_id"].iloc[:1], "ids": [b"".join(parts["ids"])]})


def encode(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK_CHARS,
           overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, ids) of every row; ``ids`` holds little-endian unsigned 32-bit ids."""
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            ids = [codec.ids(text.decode("utf-8", "replace")).tobytes() for (text,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    narrow = _narrow(docs)
    short = narrow.where(F.col("chars") <= chunk).mapInArrow(run, "doc_id long, ids binary")
    return short.unionByName(_long_ids(narrow.where(F.col("chars") > chunk), ranks, chunk, overlap))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, raw) from ``encode``: the bytes the ids stand for."""
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            raw = [codec.decode(np.frombuffer(ids, dtype="<u4")) for (ids,) in rows_of([batch], "ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(batch: pa.RecordBatch, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                      ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK_CHARS,
            overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Number and digests of the ids and of what they decode to, without moving the ids."""
    ranks = ranks or default_ranks()

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            yield _digest_batch(batch, [codec.digest(t.decode("utf-8", "replace")) for (t,) in rows_of([batch], "text")])

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            found = []
            for (raw,) in rows_of([batch], "ids"):
                ids = np.frombuffer(raw, dtype="<u4")
                found.append(digest_of(len(ids), ",".join(map(str, ids.tolist())), codec.decode(ids)))
            yield _digest_batch(batch, found)

    narrow = _narrow(docs)
    short = narrow.where(F.col("chars") <= chunk).mapInArrow(of_text, DIGESTS)
    long = _long_ids(narrow.where(F.col("chars") > chunk), ranks, chunk, overlap).mapInArrow(of_ids, DIGESTS)
    return short.unionByName(long)
