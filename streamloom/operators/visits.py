"""Daily unique visitors and bounces, for bounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_visits(rows: DataFrame, entry: Column, day: Column, key: str, order: tuple[str, ...]) -> DataFrame:
    """Entry rows whose day differs from that of the device's entry before, in order of arrival."""
    entries = rows.filter(entry).withColumn("_day", day)
    before = F.lag("_day").over(Window.partitionBy(key).orderBy(*order))
    return entries.withColumn("_new", ~before.eqNullSafe(F.col("_day"))).filter("_new").drop("_day", "_new")


def bounces(rows: DataFrame, entry: Column, ts: str, key: str, order: tuple[str, ...], within: str) -> DataFrame:
    """Entry rows that no other page follows in time: the next row of the device is an entry too, or
    comes ``within`` or later, or never. All rows are seen, so the end of the input decides the rest. ``kind``
    is ``match`` where an entry follows in time, ``timeout`` else."""
    by = Window.partitionBy(key).orderBy(ts, *order)
    marked = rows.withColumn("_entry", F.coalesce(entry, F.lit(False)))
    marked = marked.withColumns({"_next": F.lead(ts).over(by), "_next_entry": F.lead("_entry").over(by)})
    late = F.col("_next") >= F.col(ts) + F.expr(f"interval {within}")
    found = marked.filter(F.col("_entry") & (F.col("_next").isNull() | late | F.col("_next_entry")))
    return found.withColumn("kind", F.when(F.coalesce(~late, F.lit(False)), "match").otherwise("timeout")).drop("_entry", "_next", "_next_entry")
