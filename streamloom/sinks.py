"""Sinks: topics, routed topics, dimension tables and daily log files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .dims import BUCKETS, DimStore
from .functions.scalars import without_nulls
from .operators.routing import dim_schema, extend_options


def encoded(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts without their nulls."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def encoded_map(image: Column) -> Column:
    return F.to_json(without_nulls(image))


def write_topic(rows: DataFrame, where: str, servers: str | None = None, mode: str = "append") -> None:
    """JSON records to a Kafka topic, or to a directory of line files (gzip, which readers know by the name) that
    stands for it."""
    if servers:
        encoded(rows).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", where).save()
    else:
        encoded(rows).write.mode(mode).option("compression", "gzip").text(where)


def routed_records(rows: DataFrame, image: str = "after") -> DataFrame:
    """Each record's image for the topic that its ``sink_table`` names (``topic``, ``value``)."""
    return rows.select(F.col("sink_table").alias("topic"), encoded_map(F.col(image)).alias("value"))


def create_dim_tables(spark: SparkSession, config: DataFrame, home: str) -> list[str]:
    """An empty table for each dimension that the configuration names and that doesn't exist yet, with
    the options of its ``sink_extend``. The configuration has one row per table: it is small, and its
    creation is the driver's work."""
    made = []
    for row in config.filter("sink_type = 'hbase'").select("sink_table", "sink_columns", "sink_pk", "sink_extend").distinct().toLocalIterator():
        where = f"{home}/tables/{row['sink_table']}"
        try:
            spark.read.parquet(where).limit(0).count()
        except AnalysisException:
            empty = spark.createDataFrame([], dim_schema(row["sink_columns"], row["sink_pk"]).replace(" not null", ""))
            empty.write.options(**extend_options(row["sink_extend"])).parquet(where)
            made.append(row["sink_table"])
    return made


def put_dims(rows: DataFrame, home: str, batch: int, buckets: int = BUCKETS) -> None:
    """A batch of routed dimension rows into their tables (``dims.DimStore``). More ``buckets`` make a batch that
    touches few keys rewrite less; all that use a home must agree on them."""
    DimStore(home, buckets).merge(rows, batch)


def dim_now(spark: SparkSession, home: str, table: str, keys: DataFrame | None = None, version: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A dimension's columns as its changes leave it, or as of a version; ``keys`` (one column) are all that is looked for, if given."""
    return DimStore(home, buckets).read(spark, table, spark.read.parquet(f"{home}/tables/{table}").columns, keys, version)


def upsert(now: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A table after changes of the same columns and ``order``: of each key the last change, or the row as it was."""
    both = now.withColumn("_at", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumnRenamed(order, "_at"))
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_at"))
    return both.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_at")


def write_daily(lines: DataFrame, where: str, day: Column, column: str = "value") -> None:
    """Raw log lines in a folder for each day."""
    lines.select(F.col(column).alias("value"), day.alias("day")).write.mode("append").partitionBy("day").text(where)


def stream_daily(lines: DataFrame, where: str, day: Column, checkpoint: str, column: str = "value", **trigger) -> StreamingQuery:
    """The same for a stream: files roll with the day of their lines, and a restart neither loses nor doubles any."""
    writer = lines.select(F.col(column).alias("value"), day.alias("day")).writeStream.format("text").partitionBy("day")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start(where)


def console(rows: DataFrame, **options):
    """A stream to the console, for looking at it."""
    return rows.writeStream.format("console").options(**options).start()
