"""Small shared column helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the log tables carry naive UTC datetimes)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def parse_ts(value: str | _dt.datetime) -> _dt.datetime:
    """Parse an ISO argument the way the API does (``Z`` accepted as UTC, result naive)."""
    if isinstance(value, _dt.datetime):
        return value.replace(tzinfo=None)
    v = value.replace("Z", "+00:00")
    d = _dt.datetime.fromisoformat(v)
    if d.tzinfo is not None:
        d = d.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return d


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ilike_contains(c: str | Column, text: str, escape: bool = False) -> Column:
    """``c ILIKE '%text%'``.  By default ``%``/``_`` in ``text`` stay wildcards, as in the
    reference; ``escape=True`` matches them literally."""
    pattern = f"%{escape_like(text) if escape else text}%"
    return col(c).ilike(pattern)


def minutes(n: Column | int) -> Column:
    """An interval of ``n`` minutes."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)
