"""Streams that feed several sinks from one read, batch by batch.

A batch's records are one append to the topics (``records.Topics``), which replaces itself when the batch
runs again, so a restart after a failure neither loses nor doubles records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dims import DimStore
from ..operators import cdc, logs, routing
from ..records import Topics
from ..sinks import create_dim_tables, encoded, put_dims, routed_records
from . import stateful


def repaired_logs(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """All lines of a stream (``payload``) with the new-visitor flag (``is_new``) repaired by keyed state. Only lines
    that are flagged new, with device and time, go through the state; all others pass beside it, with
    a null flag, which means as it is."""
    docs = logs.documents(lines)
    flagged = F.coalesce((F.col("kind") != "dirty") & (F.col("is_new") == "1") & F.col("mid").isNotNull() & F.col("ts").isNotNull(), F.lit(False))
    new = docs.filter(flagged).select("mid", "is_new", "ts", F.col("raw").alias("payload"))
    rest = docs.filter(~flagged).select(F.lit(None).cast("string").alias("is_new"), F.col("raw").alias("payload"))
    return stateful.repaired_stream(new, ttl_ms).select("is_new", "payload").unionByName(rest)


def start_base_log(lines: DataFrame, out: Topics, checkpoint: str, **trigger) -> StreamingQuery:
    """Log lines to the start, page, display and dirty topics, all in one append a batch."""

    def write(batch: DataFrame, number: int) -> None:
        docs = logs.documents(batch.withColumnRenamed("is_new", "_flag"), "payload", ("_flag",))
        out.put(logs.records(docs, F.when(F.col("kind") != "dirty", F.coalesce("_flag", "is_new"))), number)

    return repaired_logs(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def start_base_db(spark: SparkSession, lines: DataFrame, read_config: Callable[[], DataFrame], out: Topics, dims: str, checkpoint: str, held: str | None = None, keep_versions: int | None = None, **trigger) -> StreamingQuery:
    """Change lines to topics and dimension tables. ``read_config()`` is called for every batch, so a
    new configuration row counts from the next batch on.

    Facts that no configuration names go to the topic ``unmatched``. With a folder ``held`` they are kept
    there as well and tried again with every batch, so that they are routed when their row arrives:
    batch n reads what batch n - 1 left, and replaces only what it left itself, so it can run again.

    Every batch leaves a version of the dimensions; with ``keep_versions`` only so many stay."""

    def write(batch: DataFrame, number: int) -> None:
        changes = cdc.without_deletes(cdc.decode_changes(batch)).withColumn("table", F.col("source.table"))
        if held and number:
            changes = changes.unionByName(spark.read.schema(changes.schema).parquet(f"{held}/batch={number - 1}"))
        changes = changes.persist()
        config = routing.current_config(read_config())
        parts = routing.route(changes, config)
        left = encoded(parts["unmatched"]).select(F.lit("unmatched").alias("topic"), "value")
        if held:
            parts["unmatched"].write.mode("overwrite").parquet(f"{held}/batch={number}")
            left = left.limit(0)
        out.put(routed_records(parts["kafka"]).unionByName(left), number)
        create_dim_tables(spark, config, dims)
        put_dims(parts["hbase"], dims, number)
        if keep_versions:
            DimStore(dims).vacuum(spark, keep_versions)
        changes.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
