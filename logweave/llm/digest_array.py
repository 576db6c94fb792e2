"""Sorted digest arrays: strings under 64-bit xxhash keys, in files that tasks memory-map.

An array is built by Spark: entries are range partitioned and sorted by digest and each partition
writes one file to the shared folder.  ``SparkContext.addFile`` brings the files to every executor,
where tasks map them (the pages are the system's, shared by all workers of a machine and given back
under pressure).  A probe is a binary search over the mapped keys, vectorised over a batch; a hit
counts only when the stored string equals the probed one, so equal digests of unlike strings
give no wrong answer.

What every executor holds grows with the array, not with the probed table.  Its size is
known before any file is sent and held against ``max_bytes``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, materialise, once, rows_of, shared_folder

#: The seed of Spark's own ``xxhash64``.
SEED = 42
SHARD_ENTRIES = 1 << 20
MAX_BYTES = 4 << 30


def digests_of(strings: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], dtype=np.uint64).view(np.int64)


def pack(digests: list[int], keys: list[bytes], payloads: list[bytes]) -> bytes:
    """One file: the number of entries, digests, ends of keys and payloads, both blobs."""
    ends = [np.cumsum([0, *map(len, blobs)], dtype="<i8") for blobs in (keys, payloads)]
    return b"".join([np.array([len(keys)], "<i8").tobytes(), np.array(digests, "<i8").tobytes(),
                     *[e.tobytes() for e in ends], *keys, *payloads])


class Shard:
    """One mapped file."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view("<i8")[0])
        at = 8
        parts = []
        for size in (n, n + 1, n + 1):
            parts.append(raw[at:at + 8 * size].view("<i8"))
            at += 8 * size
        self.digests, self.key_ends, self.payload_ends = parts
        self.keys = raw[at:at + int(self.key_ends[-1])]
        self.payloads = raw[at + int(self.key_ends[-1]):]

    @classmethod
    def mapped(cls, name: str) -> Shard:
        return once(("digest shard", name), lambda: cls(np.memmap(SparkFiles.get(name), np.uint8, "r")))

    def find(self, digests: np.ndarray, strings: list[bytes]) -> list[bytes | None]:
        """The payload of each string, None where it is not held."""
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        out: list[bytes | None] = [None] * len(strings)
        for i in np.flatnonzero(last > first).tolist():
            for k in range(int(first[i]), int(last[i])):  # more than one only where digests collide
                if self.keys[self.key_ends[k]:self.key_ends[k + 1]].tobytes() == strings[i]:
                    out[i] = self.payloads[self.payload_ends[k]:self.payload_ends[k + 1]].tobytes()
                    break
        return out


@dataclass(frozen=True)
class DigestArray:
    """Names and first digests of the files, smallest first, and the longest key's bytes."""

    names: list[str] = field(default_factory=list)
    firsts: list[int] = field(default_factory=list)
    longest: int = 0
    entries: int = 0

    def find(self, strings: list[bytes]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(strings)
        if not self.names or not strings:
            return out
        digests = digests_of(strings)
        shards = np.searchsorted(np.array(self.firsts, np.int64), digests, "right") - 1
        for s in np.unique(shards[shards >= 0]).tolist():
            rows = np.flatnonzero(shards == s)
            for i, payload in zip(rows.tolist(), Shard.mapped(self.names[s]).find(
                    digests[rows], [strings[i] for i in rows.tolist()]), strict=True):
                out[i] = payload
        return out


def build(entries: DataFrame, shard_entries: int = SHARD_ENTRIES, max_bytes: int = MAX_BYTES) -> DigestArray:
    """The array of ``entries(key string, payload binary)``; keys must differ.

    Raises where the files would take more than ``max_bytes`` on an executor.  The driver gets one
    row a file.
    """
    spark = entries.sparkSession
    folder = shared_folder(spark, "digests")
    keyed = materialise(entries.select(F.xxhash64("key").alias("digest"), F.col("key").cast("binary").alias("key"), "payload"),
                        "digest-entries")
    count, size = keyed.agg(F.count(F.lit(1)), F.sum(F.lit(24) + F.octet_length("key") + F.octet_length("payload"))).first()
    if not count:
        return DigestArray()
    if size > max_bytes:
        raise ValueError(f"the digest array takes {size} bytes on every executor, more than max_bytes={max_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(batches, "digest", "key", "payload"))  # a range of about ``shard_entries``
        if rows:
            name = f"digests-{uuid.uuid4().hex}"
            store, base = filesystem(folder)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pack(*map(list, zip(*rows, strict=True))))
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [rows[0][0]],
                                              "longest": [max(len(r[1]) for r in rows)]})

    dealt = keyed.repartitionByRange(-(-count // shard_entries), "digest").sortWithinPartitions("digest")
    files = materialise(dealt.mapInArrow(run, "name string, first long, longest long"), "digest-files")
    files = sorted(files.collect(), key=lambda f: f["first"])
    for f in files:
        spark.sparkContext.addFile(f"{folder}/{f['name']}")
    return DigestArray([f["name"] for f in files], [f["first"] for f in files], max(f["longest"] for f in files), count)
