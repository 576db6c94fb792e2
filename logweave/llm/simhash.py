"""SimHash near-duplicates through a byte-position inverted index with count filtering (op 1).

Fingerprint: 64 majority bits over the XXH64 (seed 42) of a text's 3-word shingles.  Two
fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share
at least 5 positional bytes: that is the guaranteed minimum of the count filter.

Index: postings are keyed by the bytes at three positions of one half (4 triples a half, 8 in
all).  Five shared bytes put at least three into one half, so every wanted pair meets in some
posting, while a posting of 24 key bits stays short where a single byte's posting would hold
1/256 of the corpus.  Each pair that meets has its shared positional bytes tallied; only pairs
with 5 or more are verified by bit distance.

Long postings (large families of near copies) never become a list of pairs: they are dealt
into blocks, each pair of blocks is one bounded task that returns a spanning forest of the
links it found.  Connected components of all of it give the groups.

Defined results: null or wordless text has fingerprint zero, linked like any other; repeated
rows all come back; a null doc_id takes its group's smallest id (null if there is none); an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialise, rows_of, utf8

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Postings up to this length are joined; longer ones go block by block.
SHORT_POSTING = 64
BLOCK = 2048
#: Shingles whose bits are counted at once.
SLICE = 1 << 15

TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def simhash(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text as an unsigned 64-bit number."""
    found = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    total, ones = 0, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(text, words, seed) for (text,) in rows_of([batch], "text")]
            column = pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _byte(position: int, column: str = "fp") -> F.Column:
    return F.shiftrightunsigned(F.col(column), 8 * position).bitwiseAND(F.lit(255).cast("long"))


def postings(distinct: DataFrame) -> DataFrame:
    """(key, fp): one posting entry for each of the eight byte triples of a fingerprint."""
    keys = []
    for n, triple in enumerate(TRIPLES):
        key = F.lit(n).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _tally(a: str, b: str) -> F.Column:
    """Positional bytes that two fingerprints share."""
    return sum((F.when(_byte(p, a) == _byte(p, b), 1).otherwise(0) for p in range(8)), F.lit(0))


def _forest(max_bits: int):
    need = 8 - max_bits

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(cell["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
        raw = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
        left, us, vs = np.ones(len(fps), dtype=bool), [], []
        for root in range(len(fps)):
            if not left[root]:
                continue
            left[root], reach = False, [root]
            while reach:
                at = reach.pop()
                rest = np.flatnonzero(left)
                shared = (raw[rest] == raw[at]).sum(axis=1)
                rest = rest[shared >= need]
                rest = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits]
                left[rest] = False
                reach.extend(rest.tolist())
                us.extend(rest.tolist())
                vs.extend([at] * len(rest))
        signed = fps.view(np.int64)
        return pd.DataFrame({"u": signed[us], "v": signed[vs]})

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) pairs of linked fingerprints that span every group of ``distinct(fp)``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the byte triples guarantee distances up to 3 bits")
    index = materialise(postings(distinct), "postings")
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = materialise(index.join(sizes, "key"), "shared-postings")

    short = listed.where(F.col("size") <= SHORT_POSTING).select("key", "fp")
    pairs = (short.select("key", F.col("fp").alias("u"))
             .join(short.select("key", F.col("fp").alias("v")), "key")
             .where("u < v").where(_tally("u", "v") >= 8 - max_bits)
             .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
             .select("u", "v"))

    blocks = F.ceil(F.col("size") / BLOCK)
    cells = (listed.where(F.col("size") > SHORT_POSTING)
             .withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    forest = cells.groupBy("key", "i", "j").applyInPandas(_forest(max_bits), "u long, v long")
    return pairs.unionByName(forest).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text)``."""
    base = materialise(fingerprints(docs, words), "fingerprints")
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = materialise(links(nodes.select("fp"), max_bits), "links")
    roots = connected_components(found).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = placed.join(smallest, "root").select("fp", "component_id")
    return base.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Of repeated rows with the kept id one stays.  Rows without a doc_id all stay, as there is
    nothing to choose among them by.
    """
    names = docs.columns
    tagged = near_duplicates(docs, words, max_bits)
    chosen = (tagged.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
              .withColumnRenamed("doc_id", "__chosen"))
    kept = docs.join(chosen, docs["doc_id"] == chosen["__chosen"])
    single = kept.where(F.col("__rows") == 1).select(*names)
    repeated = kept.where(F.col("__rows") > 1).select(*names).dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(docs.where("doc_id is null"))
