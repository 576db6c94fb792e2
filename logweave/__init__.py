"""logweave: log analytics as Spark DataFrame operators and Structured Streaming jobs.

Layout
------
functions/  column expressions (normalisation, PII, vectors, text) — stay inside codegen
operators/  DataFrame -> DataFrame operators (search, volume, detectors, clustering, ...)
sources/    readers, fixture views over the test tables, sinks
streaming/  Structured Streaming pipelines (multi-line state, two-track ingest, live volume)
plans/      the registered query catalogue (Spark plans + DuckDB oracle SQL)
"""

__version__ = "0.1.0"

# Functions handed to applyInPandas / mapInPandas / transformWithStateInPandas live in this
# package; pickling them by value lets executors run them without the package installed
# (cluster jobs otherwise need --py-files).
try:  # pragma: no cover - depends on the PySpark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
