"""Interval joins, their wide rows, and dimension lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_years, date_part, hour_part, to_ms


#: Names the column that is true in rows of a stream's batch and false in those that waited for it.
FRESH = "_fresh"


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, before: str, after: str, lower_exclusive: bool = False, upper_exclusive: bool = False) -> DataFrame:
    """Inner join of rows of one key whose right time is in ``[left - before, left + after]``. The key
    shuffles; the range is part of the join's condition. Streams need watermarks on both sides, and
    the range then bounds their state. Facts are never broadcast: how many rows a document column gives isn't
    known from its size."""
    low, high = F.col(left_ts) - F.expr(f"interval {before}"), F.col(left_ts) + F.expr(f"interval {after}")
    r = F.col(right_ts)
    return left.join(right.hint("shuffle_merge"), on & (r > low if lower_exclusive else r >= low) & (r < high if upper_exclusive else r <= high))


_ORDER = ["order_status", "create_time", "create_date", "create_hour", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "total_amount", "province_id", "user_id"]
_DETAIL = ["sku_id", "sku_name", "order_price", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"]


def _marked(rows: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(ts, delay) if delay else rows


def _new_pair(left: DataFrame, right: DataFrame) -> Column:
    """Whether a pair is new: those of two rows that waited were made before."""
    both = all(FRESH in side.columns for side in (left, right))
    return F.col(f"l.{FRESH}") | F.col(f"r.{FRESH}") if both else F.lit(True)


def timed(rows: DataFrame, ts: str, zone: str = "+00:00") -> DataFrame:
    """Rows with their ``create_time`` as a timestamp."""
    return rows.withColumn(ts, F.timestamp_millis(to_ms(F.col("create_time"), zone)))


def order_wide(orders: DataFrame, details: DataFrame, slack: str = "5 seconds", delay: str | None = None) -> DataFrame:
    """Orders with their details of nearly the same time. Columns that neither side fills are null.
    Streams need a ``delay`` for their watermarks."""
    return order_pairs(_marked(timed(orders, "o_ts"), "o_ts", delay), _marked(timed(details, "d_ts"), "d_ts", delay), slack)


def order_pairs(orders: DataFrame, details: DataFrame, slack: str) -> DataFrame:
    """The same of rows that have their times, ``o_ts`` and ``d_ts``. Parts of texts are cut out of pairs only."""
    o, d = orders.alias("l"), details.alias("r")
    rows = interval_join(o, d, (F.col("l.id") == F.col("r.order_id")) & _new_pair(orders, details), "o_ts", "d_ts", slack, slack)
    made = {"create_date": date_part(F.col("l.create_time")), "create_hour": hour_part(F.col("l.create_time"))}
    unset = [F.lit(None).cast(k).alias(n) for n, k in (("split_feight_fee", "decimal(16,2)"), ("expire_time", "string"), ("operate_time", "string"))]
    return rows.select(F.col("l.id").alias("order_id"), *[made[c].alias(c) if c in made else F.col(f"l.{c}") for c in _ORDER], F.col("r.id").alias("detail_id"), *[F.col(f"r.{c}") for c in _DETAIL], *unset)


def merged_orders(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of rows of one shape: each column's first value that is not null."""
    rows = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    return rows.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in a.columns])


def payment_wide(payments: DataFrame, wides: DataFrame, before: str = "15 minutes", after: str = "5 seconds", zone: str = "+00:00", delay: str | None = None) -> DataFrame:
    """Payments with the order rows from ``before`` to ``after`` around them. A payment's value wins
    over the order's of the same name, null or not. Streams need a ``delay`` for their watermarks."""
    return payment_pairs(_marked(timed(payments, "p_ts", zone), "p_ts", delay), _marked(timed(wides, "w_ts", zone), "w_ts", delay), before, after)


def payment_pairs(payments: DataFrame, wides: DataFrame, before: str, after: str) -> DataFrame:
    """The same of rows that have their times, ``p_ts`` and ``w_ts``."""
    p, w = payments.alias("l"), wides.alias("r")
    rows = interval_join(p, w, (F.col("l.order_id") == F.col("r.order_id")) & _new_pair(payments, wides), "p_ts", "w_ts", before, after)
    own = [F.col("l.id").alias("payment_id"), F.col("l.create_time").alias("payment_create_time"), F.col("r.create_time").alias("order_create_time")]
    same = [c for c in payments.columns if c not in ("id", "create_time", "p_ts", FRESH)]
    return rows.select(*own, *[F.col(f"l.{c}") for c in same], *[F.col(f"r.{c}") for c in wides.columns if c not in (*same, "create_time", "w_ts", FRESH)])


@dataclass(frozen=True)
class Lookup:
    """A dimension: its table, its key column, the fact's key, and fact column -> dimension column."""

    table: str
    key: str
    fact_key: str
    columns: dict[str, str | Column] = field(default_factory=dict)


def lookup(facts: DataFrame, dim: DataFrame, spec: Lookup, how: str = "inner") -> DataFrame:
    """Facts with a dimension's columns, which replace those of the same name. Keys meet as text.
    ``inner`` loses facts without a dimension row (what can be observed of an asynchronous lookup that
    fails), ``left`` keeps them. Spark broadcasts the dimension where its own size check allows."""
    d = dim.select(F.col(spec.key).cast("string").alias("_key"), *[(v if isinstance(v, Column) else F.col(v)).alias(f"_d_{n}") for n, v in spec.columns.items()])
    rows = facts.join(d, F.col(spec.fact_key).cast("string") == F.col("_key"), how)
    return rows.select(*[c for c in facts.columns if c not in spec.columns], *[F.col(f"_d_{n}").alias(n) for n in spec.columns])


def order_lookups(as_of: Column) -> list[Lookup]:
    """The six dimensions of an order row, in an order that their keys allow."""
    return [
        Lookup("DIM_USER_INFO", "ID", "user_id", {"user_gender": "GENDER", "user_age": age_years(F.col("BIRTHDAY").cast("date"), as_of)}),
        Lookup("DIM_BASE_PROVINCE", "ID", "province_id", {"province_name": "NAME", "province_area_code": "AREA_CODE", "province_iso_code": "ISO_CODE", "province_3166_2_code": "ISO_3166_2"}),
        Lookup("DIM_SKU_INFO", "ID", "sku_id", {"sku_name": "SKU_NAME", "category3_id": "CATEGORY3_ID", "spu_id": "SPU_ID", "tm_id": "TM_ID"}),
        Lookup("DIM_SPU_INFO", "ID", "spu_id", {"spu_name": "SPU_NAME"}),
        Lookup("DIM_BASE_TRADEMARK", "ID", "tm_id", {"tm_name": "TM_NAME"}),
        Lookup("DIM_BASE_CATEGORY3", "ID", "category3_id", {"category3_name": "NAME"}),
    ]


def enrich(facts: DataFrame, dims: dict[str, DataFrame] | Callable[[str, DataFrame], DataFrame], specs: list[Lookup], how: str = "inner") -> DataFrame:
    """All lookups, one after the other. ``dims`` are the tables by name, or a function that reads one for
    the keys that it is given (``sinks.dim_now``)."""
    for spec in specs:
        dim = dims(spec.table, facts.select(spec.fact_key)) if callable(dims) else dims[spec.table]
        facts = lookup(facts, dim, spec, how)
    return facts
