"""Search and retrieval: Q1-Q9.

Scale notes
* Q1 equality on ``level`` and the ``ts`` range are pushed into the Parquet scan; ILIKE is
  evaluated after the scan inside whole-stage codegen.
* Q2 is a left-semi join: shuffled on ``log_id`` at scale, never a collected id list.
* Q3/Q7/Q8 page through ``TakeOrderedAndProject``: each task keeps ``offset+limit`` rows.
* Q4 joins the anomaly table only for the rows of a page: the page (<= 1000 rows, proven by
  the limit check) is broadcast into a semi join that shrinks the anomaly table first.
* Q9 is one scan with GROUPING SETS (Expand + one partial/final aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import ilike_contains, parse_ts, ts_lit

MAX_PAGE = 1000


def search(logs: DataFrame, query: str | None = None, level: str | None = None,
           service: str | None = None, start_time=None, end_time=None,
           is_anomaly: bool | None = None, anom: DataFrame | None = None,
           escape: bool = False) -> DataFrame:
    """Q1 + Q2: AND of the given filters (level exact after upper-casing, service and message
    ILIKE '%x%', inclusive time bounds on ``ts``, anomaly membership)."""
    df = logs
    if is_anomaly is not None:
        if anom is None:
            raise ValueError("is_anomaly filter needs the anomaly table")
        # "is_anomaly=false" means "has a result row with false", not "has no row".
        ids = anom.filter(F.col("is_anomaly") == F.lit(bool(is_anomaly))).select("log_id")
        df = df.join(ids, "log_id", "left_semi")
    if level:
        df = df.filter(F.col("level") == level.upper())
    if service:
        df = df.filter(ilike_contains("service", service, escape))
    if start_time:
        df = df.filter(F.col("ts") >= ts_lit(parse_ts(start_time)))
    if end_time:
        df = df.filter(F.col("ts") <= ts_lit(parse_ts(end_time)))
    if query:
        df = df.filter(ilike_contains("message", query, escape))
    return df


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be in 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def paginate(df: DataFrame, limit: int = 100, offset: int = 0,
             order_col: str = "created_at", id_col: str = "log_id") -> DataFrame:
    """Q3: newest first by ``order_col`` (id tie-break), one page, plus ``total`` and
    ``has_more`` as scalar-subquery columns (no join, no second materialisation)."""
    _check_page(limit, offset)
    total = df.select(F.count(F.lit(1))).scalar()
    page = df.orderBy(F.col(order_col).desc(), F.col(id_col).desc()).offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < total)


def with_anomaly(page: DataFrame, anom: DataFrame, max_rows: int = MAX_PAGE * 10) -> DataFrame:
    """Q4: attach ``is_anomaly`` (missing => false) and ``anomaly_score`` (missing => NULL).

    ``page`` must be bounded (a page or a top-k).  Its ids are broadcast into a semi join
    that reduces the anomaly table to the page's rows, then the small result is joined back.
    """
    ids = page.select("log_id")
    small = anom.select("log_id", "is_anomaly", "anomaly_score") \
        .join(F.broadcast(ids), "log_id", "left_semi")
    out = page.join(F.broadcast(small), "log_id", "left")
    return out.withColumn("is_anomaly", F.coalesce(F.col("is_anomaly"), F.lit(False)))


def search_page(logs: DataFrame, anom: DataFrame, limit: int = 100, offset: int = 0,
                **filters) -> DataFrame:
    """Text search end to end (Q1-Q4): filters, page, total/has_more, anomaly columns."""
    df = search(logs, anom=anom, **filters)
    page = paginate(df, limit, offset)
    return with_anomaly(page, anom)


def get_log(logs: DataFrame, log_id) -> DataFrame:
    """Q6: point lookup including ``raw_log`` (equality pushed into the scan)."""
    return logs.filter(F.col("log_id") == F.lit(log_id))


def search_compact(logs: DataFrame, query: str | None = None, level: str | None = None,
                   service: str | None = None, start_time=None, end_time=None,
                   limit: int = 20) -> DataFrame:
    """Q7: analyst search — newest by event time, at most 100 rows, message cut at 200."""
    n = int(limit)
    if not 1 <= n <= 100:
        raise ValueError("limit must be 1 to 100")
    df = search(logs, query=query, level=level, service=service,
                start_time=start_time, end_time=end_time)
    return df.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(n).select(
        "log_id", "ts", "level", "service", F.substring("message", 1, 200).alias("message"))


def recent_context(logs: DataFrame, log_id, n: int = 5) -> DataFrame:
    """Q8: the ``n`` newest logs other than ``log_id``."""
    return logs.filter(F.col("log_id") != F.lit(log_id)) \
        .orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(n)


def facets(logs: DataFrame, anom: DataFrame, cap: int | None = None) -> DataFrame:
    """Q9: facet counts by service, level, cluster and anomaly flag.

    ``cluster_id`` comes from the anomaly table (B33 — the reference's search rows lack it,
    so its cluster facet is always empty).  ``cap`` reproduces the dashboard's newest-N view.
    """
    df = logs
    if cap is not None:
        df = df.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(int(cap))
    a = anom.select("log_id", "is_anomaly", "cluster_id")
    df = df.select("log_id", "service", "level").join(a, "log_id", "left") \
        .withColumn("is_anomaly", F.coalesce(F.col("is_anomaly"), F.lit(False)))
    g = df.groupingSets([["service"], ["level"], ["cluster_id"], ["is_anomaly"]],
                        "service", "level", "cluster_id", "is_anomaly") \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    facet = (F.when(F.col("gid") == 7, "service").when(F.col("gid") == 11, "level")
             .when(F.col("gid") == 13, "cluster").otherwise("anomaly"))
    value = (F.when(F.col("gid") == 7, F.col("service")).when(F.col("gid") == 11, F.col("level"))
             .when(F.col("gid") == 13, F.col("cluster_id").cast("string"))
             .otherwise(F.col("is_anomaly").cast("string")))
    return g.select(facet.alias("facet"), value.alias("value"), F.col("n").cast("bigint").alias("n"))
