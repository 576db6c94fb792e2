"""Embedding preparation: content hash, cache split, cost, budget admission, chunking,
pluggable batch embedding, statistics (E1-E7).
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .admission import admit  # noqa: F401 - E4 is part of this module's interface
from .numbering import number_rows

# Fixed values (must equal the reference): price per million tokens of the small embedding
# model, characters per token estimate, request size.
PRICE_PER_MILLION_TOKENS = 0.02
CHARS_PER_TOKEN = 4
MAX_TEXTS_PER_REQUEST = 2048


def text_hash(c: str = "text"):
    """SHA-256 of the UTF-8 text (hex)."""
    return F.sha2(F.col(c), 256)


def estimate_cost(df: DataFrame, text_col: str = "text") -> DataFrame:
    """tokens = floor(len/4); cost = tokens / 1e6 * 0.02 USD."""
    tokens = F.floor(F.length(text_col) / CHARS_PER_TOKEN).cast("bigint")
    return df.withColumn("tokens", tokens) \
        .withColumn("cost_usd", F.col("tokens") / F.lit(1e6) * F.lit(PRICE_PER_MILLION_TOKENS))


def split_cached(df: DataFrame, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, misses).  Hits carry the cached vector; misses are distinct by hash (B31:
    duplicates inside a batch are embedded once and joined back by hash)."""
    h = df.withColumn("text_hash", text_hash(text_col))
    hits = h.join(cache, "text_hash", "inner")
    misses = h.join(cache.select("text_hash"), "text_hash", "left_anti") \
        .groupBy("text_hash").agg(F.min(text_col).alias(text_col))
    return hits, misses


def chunk(df: DataFrame, n: int = MAX_TEXTS_PER_REQUEST, order_cols=("text_hash",),
          partition_cols=()) -> DataFrame:
    """E5: request numbers of at most ``n`` texts: floor((row_number - 1) / n) within
    ``partition_cols`` (a day, a service), however many rows one of them holds."""
    numbered = number_rows(df, order_cols, partition_cols)
    return numbered.withColumn("request_no", F.floor((F.col("row_no") - 1) / n).cast("bigint")).drop("row_no")


# ---- pluggable embedding ------------------------------------------------------------------

_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Offline default model: signed feature hashing of lower-cased word tokens, L2-normalised.
    Deterministic across processes (MD5 of the token), so retries give identical vectors."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            for tok in _TOKEN.findall((t or "").lower()):
                h = int.from_bytes(hashlib.md5(tok.encode("utf-8")).digest()[:8], "little")
                out[i, h % dim] += 1.0 if (h >> 63) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return out / n
    return embed


def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray] | None = None,
          text_col: str = "text", model: str = "hashing-64", as_of=None,
          batch_size: int = MAX_TEXTS_PER_REQUEST) -> DataFrame:
    """Embed texts through a batch function inside ``mapInPandas`` (Arrow batches of at
    most ``batch_size`` rows = one request each).  Adds embedding, model, timestamp, tokens,
    per-item cost, cached=false."""
    fn = fn or hashing_embedder()
    ts = _dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else (as_of or _dt.datetime(1970, 1, 1))
    in_cols = df.columns
    schema = (df.schema.simpleString()[len("struct<"):-1] +
              ",embedding array<float>,embedding_model string,embedding_timestamp timestamp_ntz,"
              "embedding_tokens bigint,embedding_cost_usd double,embedding_cached boolean")

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                texts = part[text_col].fillna("").tolist()
                vecs = fn(texts) if texts else np.zeros((0, 0))
                part["embedding"] = [np.asarray(v, dtype=np.float32) for v in vecs]
                part["embedding_model"] = model
                part["embedding_timestamp"] = pd.Timestamp(ts)
                toks = np.array([len(t) // CHARS_PER_TOKEN for t in texts], dtype=np.int64)
                part["embedding_tokens"] = toks
                part["embedding_cost_usd"] = toks / 1e6 * PRICE_PER_MILLION_TOKENS
                part["embedding_cached"] = False
                yield part[in_cols + ["embedding", "embedding_model", "embedding_timestamp",
                                      "embedding_tokens", "embedding_cost_usd", "embedding_cached"]]
    return df.mapInPandas(run, schema)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Cache size, tokens and cost held."""
    return cache.agg(F.count(F.lit(1)).alias("entries"),
                     F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
                     F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 9).alias("cost_usd"))


def clear_cache(cache: DataFrame, older_than=None) -> DataFrame:
    """Invalidation — everything, or entries created before ``older_than``."""
    if older_than is None:
        return cache.limit(0)
    return cache.filter(F.col("created_at") >= F.lit(older_than).cast("timestamp_ntz"))


def budget_stats(spend: DataFrame, daily_budget_usd: float) -> DataFrame:
    """Per day spent, remaining = max(0, budget - spent), utilisation %."""
    b = F.lit(float(daily_budget_usd))
    s = spend.groupBy("day").agg(F.sum("cost_usd").alias("spent_usd"))
    return s.select("day", F.round("spent_usd", 9).alias("spent_usd"),
                    F.round(F.greatest(F.lit(0.0), b - F.col("spent_usd")), 9).alias("remaining_usd"),
                    F.round(F.col("spent_usd") / b * 100, 6).alias("utilisation_pct"))


def usage_by_model(embedded: DataFrame) -> DataFrame:
    """A4: requests, cache hits, tokens and cost by model.

    Expects ``embedding_model``, ``embedding_cached``, ``embedding_tokens`` and
    ``embedding_cost_usd``; hits cost nothing.
    """
    paid = ~F.coalesce(F.col("embedding_cached"), F.lit(False))
    return embedded.groupBy("embedding_model").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(~paid).alias("cache_hits"),
        F.coalesce(F.sum(F.when(paid, F.col("embedding_tokens"))), F.lit(0)).cast("bigint").alias("tokens"),
        F.round(F.coalesce(F.sum(F.when(paid, F.col("embedding_cost_usd"))), F.lit(0.0)), 9).alias("cost_usd"))
