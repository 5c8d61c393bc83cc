"""One function for each job, over the directories or topics that stand between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import apart, date_text, is_empty, typed_json
from ..operators import cdc, joins, logs, routing, stats, visits
from ..schemas import LOG, ORDER_DETAIL, ORDER_INFO, PAYMENT_INFO, TABLE_PROCESS, names
from ..records import Topics
from ..sinks import create_dim_tables, put_dims, routed_records


def log_records(lines: DataFrame) -> DataFrame:
    """Raw logs as the records of the four log topics (``topic``, ``value``), new-visitor flags repaired.
    Lines without device or time keep their flag and have no part in another's."""
    docs = logs.documents(lines).withColumn("mid", F.when((F.col("kind") != "dirty") & F.col("ts").isNotNull(), F.col("mid")))
    fixed = logs.repair_new_visitor(docs, order=("ts", "raw"))
    return logs.records(fixed, F.when(F.col("kind") != "dirty", F.col("is_new")))


def base_log(lines: DataFrame) -> dict[str, DataFrame]:
    """The same by topic, as ``start``, ``page``, ``display`` and ``dirty``."""
    rows = log_records(lines)
    return {name: rows.filter(F.col("topic") == name).select("value") for name in logs.TOPICS}


def pages_of(lines: DataFrame, **more: Column) -> DataFrame:
    """Page lines as typed rows, with more columns if wanted."""
    return lines.select(F.from_json("value", LOG).alias("l"), *[c.alias(n) for n, c in more.items()]).select("l.*", *more).withColumns({"mid": F.col("common.mid"), "time": F.timestamp_millis("ts")})


def unique_visit(pages: DataFrame) -> DataFrame:
    return visits.unique_visits(pages, is_empty(F.col("page.last_page_id")), date_text(F.col("time")), "mid", ("ts",))


def user_jump(pages: DataFrame, within: str = "10 seconds") -> DataFrame:
    return visits.bounces(pages, is_empty(F.col("page.last_page_id")), "time", "mid", ("ts",), within)


def visitor_stats(pages: DataFrame, unique: DataFrame, jumps: DataFrame, width: str = "10 seconds") -> DataFrame:
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("time", "page", *[F.col(f"common.{c}").alias(c) for c in stats.DIMENSIONS])

    keep = ["time", *stats.DIMENSIONS]
    page = stats.page_rows(keyed(pages), keep, F.col("page.last_page_id"), F.col("page.during_time"))
    return stats.windowed([stats.unique_rows(keyed(unique), keep), stats.jump_rows(keyed(jumps), keep), page], "time", width)


def base_db(spark: SparkSession, lines: DataFrame, config: DataFrame, out: Topics, dims: str, aliases: bool = True, batch: int = 0) -> DataFrame:
    """Changes routed by the current configuration: topics written, dimensions created and their rows
    put (``sinks.dim_now`` reads them). Returns facts without configuration, which are kept for a later
    try rather than lost. For use in foreachBatch, with the batch's number. The changes are decoded once."""
    changes = cdc.without_deletes(cdc.decode_changes(lines)).withColumn("table", F.col("source.table")).persist()
    now = routing.current_config(config, aliases=aliases)
    parts = routing.route(changes, now)
    out.put(routed_records(parts["kafka"]), batch)
    create_dim_tables(spark, now, dims)
    put_dims(parts["hbase"], dims, batch)
    return parts["unmatched"]


def order_pairs(orders: DataFrame, details: DataFrame, slack: str = "5 seconds", delay: str | None = None) -> DataFrame:
    """Order and detail records, joined; ``delay`` bounds the state of streams."""
    return joins.order_wide(orders_of(orders), details_of(details), slack, delay)


def orders_of(lines: DataFrame) -> DataFrame:
    return apart(lines, F.from_json("value", ORDER_INFO))


def details_of(lines: DataFrame) -> DataFrame:
    return apart(lines, F.from_json("value", ORDER_DETAIL))


def payments_of(lines: DataFrame) -> DataFrame:
    return apart(lines, F.from_json("value", PAYMENT_INFO))


def order_wide(orders: DataFrame, details: DataFrame, dims: dict[str, DataFrame], as_of: Column, how: str = "inner", slack: str = "5 seconds") -> DataFrame:
    """Order and detail records to enriched order rows."""
    return joins.enrich(order_pairs(orders, details, slack), dims, joins.order_lookups(as_of), how)


def payment_wide(payments: DataFrame, wides: DataFrame, before: str = "15 minutes", after: str = "5 seconds", delay: str | None = None) -> DataFrame:
    return joins.payment_wide(payments_of(payments), wides, before, after, delay=delay)


def config_of(changes: DataFrame) -> DataFrame:
    """The configuration table as its change feed leaves it; deletions take rows away. Columns may be named
    in snake or camel case."""
    image = typed_json(F.to_json(F.coalesce("after", "before")), TABLE_PROCESS)
    keyed = changes.select("op", "ts_ms", image.alias("i")).select("op", "ts_ms", "i.*")
    return cdc.latest(keyed, ["source_table", "operate_type"], ["ts_ms"]).select(*names(TABLE_PROCESS), "ts_ms")


def run_base_log(lines: DataFrame, out: Topics, batch: int | None = None) -> None:
    """The log job in batch form: one read, one write to all four topics."""
    out.put(log_records(lines), batch)
