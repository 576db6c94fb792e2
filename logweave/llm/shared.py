"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words of every contract here: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows never recomputes ``df``, also after lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(filesystem, path) of a Hadoop-style URI."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:/*)?(/.*|[^:/].*)", uri)
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri).lstrip("/") if local else uri
    return fs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: str = "text") -> F.Column:
    """The column's UTF-8 bytes; null text counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(u, v)``; root is the component's smallest node.

    Alternating large-star / small-star rounds: each round is two grouped minima and two equi
    joins, the state is written to the shared folder after each, and the loop ends when a round
    changes nothing.  Stars of any size stay spread over many rows; no neighbour list is built.
    """
    state = materialise(_downward(edges), "edges")
    mark = _digest(state)
    while True:
        state = materialise(_small_star(_large_star(state)), "edges")
        before, mark = mark, _digest(state)
        if mark == before:
            break
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _downward(edges: DataFrame) -> DataFrame:
    return (edges.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    joined = edges.join(low, "u")
    return (joined.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("low").alias("v"))).distinct())


def rows_of(batches: Iterable, *columns: str):
    """Python values of ``columns``, row by row, of a stream of Arrow batches."""
    for batch in batches:
        picked = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in picked)


def once(key: tuple, make: Callable):
    """A value built once in each Python process.

    This package's functions are shipped by value, so their globals live no longer than a
    task; what is costly to open is kept with the interpreter instead.
    """
    held = sys.__dict__.setdefault("_logweave_once", {})
    if key not in held:
        held[key] = make()
    return held[key]
