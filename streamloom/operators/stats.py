"""Visitor statistics: three row kinds united and summed in tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_ms, is_empty, ymd_hms

COUNTS = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")
DIMENSIONS = ("ar", "ch", "is_new", "vc")


def stats_rows(rows: DataFrame, keep: list[str], **counts: Column | int) -> DataFrame:
    """Rows of one kind with the counts that it gives; the others are 0."""
    made = {c: counts.get(c, 0) for c in COUNTS}
    return rows.select(*keep, *[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(c) for c, v in made.items()])


def unique_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    return stats_rows(rows, keep, uv_ct=1)


def jump_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    return stats_rows(rows, keep, uj_ct=1)


def page_rows(rows: DataFrame, keep: list[str], last_page: Column, during: Column) -> DataFrame:
    return stats_rows(rows, keep, pv_ct=1, sv_ct=F.when(is_empty(last_page), 1).otherwise(0), dur_sum=F.coalesce(during, F.lit(0)))


def windowed(parts: list[DataFrame], ts: str, width: str, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Sums by window and dimensions, with the window's ends as text. The partial sums combine before
    the one shuffle. ``ts`` is that of the row that arrived first, in milliseconds, where rows say when they did
    (``arrived``, anything that can be ordered); else the least of the group."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ms = epoch_ms(F.col(ts)) if isinstance(rows.schema[ts].dataType, T.TimestampNTZType) else F.unix_millis(ts)
    first = F.min_by(ms, "arrived") if "arrived" in rows.columns else F.min(ms)
    sums = rows.groupBy(F.window(ts, width).alias("w"), *dimensions).agg(*[F.sum(c).alias(c) for c in COUNTS], first.alias("ts"))
    return sums.select(ymd_hms(F.col("w.start")).alias("stt"), ymd_hms(F.col("w.end")).alias("edt"), *dimensions, *COUNTS, "ts")
