"""The jobs of the detail and statistics layers as streams, source to sink: lines in, records out.

Each is the batch form of ``plans.jobs`` with watermarks and managed state. A query ends when its
input is read (``availableNow``) unless another trigger is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import apart, date_text, is_empty
from ..operators import joins, stats
from ..plans import jobs
from ..schemas import ORDER_WIDE
from ..records import Topics
from ..sinks import encoded
from . import stateful
from .joins import LATE, RISING, start_joined, windowed_stream


def _pages(lines: DataFrame) -> DataFrame:
    """Page lines for the keyed state, the line itself as ``payload``; those without device or time go."""
    rows = lines.select("value", *[F.get_json_object("value", f"$.{p}").alias(n) for p, n in (("common.mid", "mid"), ("page.last_page_id", "last"), ("ts", "ts"))])
    rows = rows.select("mid", F.col("ts").cast("long").alias("ts"), is_empty(F.col("last")).alias("entry"), F.col("value").alias("payload"))
    return apart(rows).filter("mid is not null and ts is not null").withColumn("time", F.timestamp_millis("ts"))


def start_unique_visit(pages: DataFrame, out: Topics, checkpoint: str, ttl_ms: int | None = stateful.DAY_MS, topic: str = "dwm_unique_visit", **trigger) -> StreamingQuery:
    """Page lines to those of daily unique visitors. A device's day is forgotten ``ttl_ms`` after its last
    entry. State that expires keeps a stream running, so the job then goes on, batch after batch, unless a
    trigger says otherwise; with None the state stays and the stream ends with its input."""
    entries = _pages(pages).filter("entry").select("mid", date_text(F.col("time")).alias("day"), "ts", "payload")
    going = trigger or ({"availableNow": True} if ttl_ms is None else {"processingTime": "1 second"})
    return out.stream(stateful.unique_visit_stream(entries, ttl_ms).select(F.col("payload").alias("value")), checkpoint, topic, **going)


def start_user_jump(pages: DataFrame, out: Topics, checkpoint: str, within_ms: int = 10_000, delay: str = "1001 milliseconds", topic: str = "dwm_user_jump_detail", timed_out: str | None = None, **trigger) -> StreamingQuery:
    """Page lines to those of bounces. ``timed_out`` names a topic of its own for those that nothing
    followed in time; without one, both kinds go to ``topic``."""
    rows = _pages(pages).select("mid", "time", F.col("ts").alias("ts_ms"), "entry", F.when(F.col("entry"), F.col("payload")).alias("payload"))  # others are never written
    found = stateful.bounce_stream(rows, within_ms, delay)
    name = F.when(F.col("kind") == "timeout", timed_out or topic).otherwise(topic)
    return out.stream(found.select(name.alias("topic"), F.col("payload").alias("value")), checkpoint, **trigger)


def start_order_wide(orders: DataFrame, details: DataFrame, read_dims: Callable[[], dict[str, DataFrame] | Callable[[str, DataFrame], DataFrame]], as_of: Column, out: Topics, checkpoint: str, how: str = "inner", slack: str = "5 seconds", delay: str = RISING, topic: str = "dwm_order_wide", **trigger) -> StreamingQuery:
    """Order and detail lines to enriched order records. ``read_dims()`` is called for every batch, so a
    lookup sees the newest rows; it gives tables by name, or a function that reads what a batch's keys need."""

    def write(pairs: DataFrame, number: int) -> None:
        rows = joins.enrich(pairs, read_dims(), joins.order_lookups(as_of), how)
        out.put(encoded(rows).withColumn("topic", F.lit(topic)), number)

    o, d = joins.timed(jobs.orders_of(orders), "o_ts"), joins.timed(jobs.details_of(details), "d_ts")
    return start_joined(o, d, "o_ts", "d_ts", slack, slack, lambda a, b: joins.order_pairs(a, b, slack), write, checkpoint, delay, **trigger)


def start_payment_wide(payments: DataFrame, wides: DataFrame, out: Topics, checkpoint: str, before: str = "15 minutes", after: str = "5 seconds", delay: str = RISING, topic: str = "dwm_payment_wide", **trigger) -> StreamingQuery:
    """Payment lines and enriched order records to payment records."""
    p, w = joins.timed(jobs.payments_of(payments), "p_ts"), joins.timed(apart(wides, F.from_json("value", ORDER_WIDE)), "w_ts")
    write = lambda pairs, number: out.put(encoded(pairs).withColumn("topic", F.lit(topic)), number)
    return start_joined(p, w, "p_ts", "w_ts", before, after, lambda a, b: joins.payment_pairs(a, b, before, after), write, checkpoint, delay, **trigger)


def start_visitor_stats(pages: DataFrame, unique: DataFrame, jumps: DataFrame, out: Topics, checkpoint: str, width: str = "10 seconds", delay: str = LATE, topic: str = "dws_visitor_stats", **trigger) -> StreamingQuery:
    """Lines of pages, unique visitors and bounces to sums by window and dimensions. Lines that come from
    a topic bring their arrival (``at``, ``part``, ``offset``); ``ts`` is then that of the first to arrive, of
    those of one time a page's, then a unique visitor's."""
    keep = ["time", *stats.DIMENSIONS]
    if all("offset" in lines.columns for lines in (pages, unique, jumps)):
        keep.append("arrived")

    def keyed(lines: DataFrame, rank: int) -> DataFrame:
        arrived = F.struct("at", F.lit(rank).alias("rank"), "part", "offset") if "arrived" in keep else F.lit(0)
        return jobs.pages_of(lines, arrived=arrived).select("time", "page", "arrived", *[F.col(f"common.{c}").alias(c) for c in stats.DIMENSIONS])

    page = stats.page_rows(keyed(pages, 0), keep, F.col("page.last_page_id"), F.col("page.during_time"))
    sums = windowed_stream([stats.unique_rows(keyed(unique, 1), keep), stats.jump_rows(keyed(jumps, 2), keep), page], "time", width, delay=delay)
    return out.stream(encoded(sums), checkpoint, topic, **trigger)
