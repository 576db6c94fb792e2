"""Raw collector records in front of multi-line assembly (M2): their source key, their line, and the fields
that an assembled record takes over from its first line.

``to_lines`` gives each raw JSON record its line and key; ``assemble_records`` runs M2 over them and returns
records again, ready for N11: an assembled one holds all fields of its first line's record but the
line's own, the joined text, ``_aggregated``, ``_line_count`` and, for errors, ``level`` and
``_detected_error``; a line that passes through keeps its record as it is.

Records that are no JSON object, or whose line is empty, take no part (as empty lines in M2).  The fields
travel as a VARIANT only where records are put together: assembly moves lines, and one equi join on
(key, seq) brings the first lines' records back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.pii import let
from . import multiline as ML

CONTAINER_ID_CHARS = 12  # fixed value
#: Fields of a first line's record that its assembled text replaces (fixed values).
LINE_FIELDS = ["log", "message"]


def _shown(record: Column, key: str) -> Column:
    """A present field as text, ``None`` for a JSON null; NULL if the field is absent."""
    kind = N.vtype(record, key)
    return F.when(kind == "VOID", F.lit("None")).when(kind.isNotNull(), N.vget(record, key))


def source_key(record: Column) -> Column:
    """``container_name`` (else ``service``, else "unknown"), a colon and the container id's first 12 characters."""
    name = F.coalesce(_shown(record, "container_name"), _shown(record, "service"), F.lit("unknown"))
    container = F.coalesce(F.substring(N.vget(record, "container_id"), 1, CONTAINER_ID_CHARS), F.lit(""))
    return F.concat(name, F.lit(":"), container)


def to_lines(records: DataFrame, value_col: str = "value", time_col: str = "arrival_ms", seq_col: str = "seq") -> DataFrame:
    """(src, arrival_ms, seq, line, value) of the records that have a line."""
    def told(v: Column) -> Column:
        return F.struct(source_key(v).alias("src"),
                        ML.strip_line(N.first_message(v, N.ASSEMBLER_LINE_KEYS)).alias("line"))

    # The generator keeps the condition on the line above it: a record is parsed and told once.
    parsed = records.select(F.col(time_col).alias("arrival_ms"), F.col(seq_col).alias("seq"), F.col(value_col).alias("value"),
                            F.explode_outer(F.array(let(N.parse_record(value_col), told))).alias("_t"))
    return parsed.select("_t.src", "arrival_ms", "seq", "_t.line", "value").where("line is not null and line <> ''")


def _record(first: Column) -> Column:
    """The assembled record as JSON; ``first`` is its first line's record."""
    fields = F.from_json(first, "map<string,variant>")
    own = F.create_map(
        F.lit("message"), F.col("message").cast("variant"), F.lit("log"), F.col("message").cast("variant"),
        F.lit("_aggregated"), F.lit(True).cast("variant"), F.lit("_line_count"), F.col("line_count").cast("variant"))
    failed = F.create_map(F.lit("level"), F.lit("ERROR").cast("variant"), F.lit("_detected_error"), F.lit(True).cast("variant"))
    error = F.col("detected_error")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*LINE_FIELDS, "_aggregated", "_line_count")
                        & ~(error & k.isin("level", "_detected_error")))
    return F.to_json(F.when(error, F.map_concat(kept, own, failed)).otherwise(F.map_concat(kept, own)))


def assemble_records(records: DataFrame, value_col: str = "value", time_col: str = "arrival_ms", seq_col: str = "seq",
                     **rules) -> DataFrame:
    """(src, first_seq, line_count, aggregated, value) of every emitted record; ``rules`` go to M2."""
    lines = to_lines(records, value_col, time_col, seq_col)
    assembled = ML.assemble_multiline(lines, **rules)
    firsts = lines.select("src", F.col("seq").alias("first_seq"), F.col("value").alias("first"))
    joined = assembled.join(firsts, ["src", "first_seq"])
    return joined.select("src", "first_seq", "line_count", "aggregated",
                         F.when(F.col("aggregated"), _record(F.col("first"))).otherwise(F.col("first")).alias("value"))
