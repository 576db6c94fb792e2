"""Log levels and the level weights of the anomaly gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

# Fixed values (must equal the reference): level weights of the anomaly gate and the
# weight of any other level.
LEVEL_WEIGHTS = {
    "ERROR": 1.0,
    "WARN": 0.8,
    "WARNING": 0.8,
    "INFO": 0.3,
    "DEBUG": 0.2,
    "TRACE": 0.1,
}
DEFAULT_LEVEL_WEIGHT = 0.5

# Explicit levels accepted by the level cascade, and the default priority
# levels that are embedded and scored.
KNOWN_LEVELS = ["DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL"]
PRIORITY_LEVELS = ["ERROR", "WARN", "WARNING", "CRITICAL", "FATAL"]
BREAKDOWN_LEVELS = ["ERROR", "WARN", "INFO", "DEBUG"]


def level_weight(level: str | Column, weights: dict[str, float] | None = None,
                 default: float = DEFAULT_LEVEL_WEIGHT) -> Column:
    """Weight of a level; a missing level counts as INFO (vector without a log row)."""
    weights = weights or LEVEL_WEIGHTS
    lv = F.upper(F.coalesce(col(level), F.lit("INFO")))
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, lv), F.lit(float(default)))


def level_gate(statistical: Column, score: Column, base_threshold: Column | float,
               weight: Column) -> Column:
    """Flag iff statistical anomaly AND (weight >= 0.8 OR score > base_threshold / weight)."""
    thr = F.when(weight > 0, F.lit(base_threshold) / weight if not isinstance(base_threshold, Column)
                 else base_threshold / weight)
    return statistical & ((weight >= F.lit(0.8)) | (thr.isNotNull() & (score > thr)))
