"""Topics with offsets: a Kafka cluster, or a folder of appends where none is at hand.

A folder's topics are Parquet files under ``append=<n>/topic=<name>``, one append for each batch of their one
writer. A batch that runs again replaces its append, so a restart neither loses nor doubles records. A
record has a partition (``part``, the task that wrote it) and an ``offset`` that rises within it: the
append's number, then the place in the task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Places within an append take so many bits of an offset.
PLACE_BITS = 40
_STORED = "key string, value string, at timestamp, part int, place bigint, append int, topic string"
_POSITION = "part int, offset bigint"


@dataclass(frozen=True)
class Topics:
    """Where topics are: ``servers`` of Kafka (whose connector must be on the class path), or a ``home``
    folder. ``partitions`` keeps records of one key in one partition, in order, at the price of a shuffle."""

    home: str = ""
    servers: str | None = None
    partitions: int | None = None

    def put(self, rows: DataFrame, batch: int | None = None, at: Column | None = None) -> None:
        """Records (``topic``, ``value`` and, if wanted, ``key``), each to the topic it names. ``batch`` numbers the
        append of a stream's batch and replaces what it wrote before; without, a new append is made.
        ``at`` is the time of arrival, by default now."""
        key = F.col("key") if "key" in rows.columns else F.lit(None)
        out = rows.select("topic", key.cast("string").alias("key"), "value", (F.current_timestamp() if at is None else at).alias("at"))
        if self.partitions and "key" in rows.columns:
            out = out.repartition(self.partitions, "topic", "key")
        if self.servers:
            out.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", self.servers).save()
            return
        if batch is None:
            batch = self._last(rows.sparkSession) + 1
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        out = out.select("key", "value", "at", F.spark_partition_id().alias("part"), place.alias("place"), "topic")
        out.write.mode("overwrite").partitionBy("topic").parquet(f"{self.home}/append={batch}")

    def _last(self, spark: SparkSession) -> int:
        try:
            last = spark.read.schema(_STORED).parquet(self.home).agg(F.max("append")).first()[0]
        except AnalysisException:
            last = None
        return -1 if last is None else last

    def read(self, spark: SparkSession, topic: str, streaming: bool = False, start: str | dict[int, int] = "earliest", group: str | None = None, pin: str | None = None, files_per_batch: int | None = None) -> DataFrame:
        """A topic's records: ``value``, ``key``, ``at``, ``part``, ``offset``.

        ``start`` is ``earliest``, ``latest``, or the next offset of each partition (others from their
        beginning). A ``group`` that has committed begins after what it committed. A stream keeps its
        own place in its checkpoint, so its beginning must not move when it is started again: ``pin`` is
        a folder, such as one beside the checkpoint, where the beginning is stored when it is first
        worked out. A topic that nothing was written to is empty.
        """
        begin = self._begin(spark, topic, start, group, pin)
        if self.servers:
            return self._kafka(spark, topic, streaming, begin, group)
        reader = (spark.readStream if streaming else spark.read).schema(_STORED).option("basePath", self.home)
        if streaming and files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        try:
            rows = reader.parquet(f"{self.home}/append=*/topic={topic}")
        except AnalysisException:
            rows = spark.createDataFrame([], _STORED)
        offset = F.shiftleft(F.col("append").cast("bigint"), PLACE_BITS) + F.col("place")
        rows = rows.select("value", "key", "at", "part", offset.alias("offset"), "append")
        if isinstance(begin, dict):
            rows = rows.filter(F.col("append") >= (min(begin.values()) >> PLACE_BITS if begin.keys() >= {None} else 0))
            known = {p: o for p, o in begin.items() if p is not None}
            least = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("part")], F.lit(begin.get(None, 0))) if known else F.lit(begin.get(None, 0))
            rows = rows.filter(F.col("offset") >= least)
        return rows.drop("append")

    def _kafka(self, spark: SparkSession, topic: str, streaming: bool, begin: str | dict, group: str | None) -> DataFrame:
        reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", topic)
        reader = reader.options(**kafka_start(topic, begin))
        if group:
            reader = reader.option("kafka.group.id", group)
        text = lambda c: F.col(c).cast("string").alias(c)
        return reader.load().select(text("value"), text("key"), F.col("timestamp").alias("at"), F.col("partition").alias("part"), "offset")

    def _begin(self, spark: SparkSession, topic: str, start: str | dict[int, int], group: str | None, pin: str | None) -> str | dict[int | None, int]:
        """The beginning as a word or as next offsets by partition; key None is that of partitions not named."""
        if pin:
            stored = _positions(spark, pin)
            if stored is not None:
                return stored
        begin: str | dict = start
        done = self.committed(spark, topic, group) if group else {}
        if done:
            begin = {p: o + 1 for p, o in done.items()}
        elif start == "latest" and not self.servers:
            begin = {None: (self._last(spark) + 1) << PLACE_BITS}
        if pin:
            rows = [*begin.items()] if isinstance(begin, dict) else [(None, 0)] if begin == "earliest" else []
            if rows:
                spark.createDataFrame(rows, _POSITION).coalesce(1).write.mode("overwrite").parquet(pin)
        return begin

    def commit(self, read: DataFrame, topic: str, group: str, batch: int) -> None:
        """Note that a group is done with records that it read (``part``, ``offset``). A row for each partition."""
        done = read.groupBy("part").agg(F.max("offset").alias("offset"))
        done.write.mode("overwrite").parquet(f"{self.home}/_groups/{group}/{topic}/batch={batch}")

    def committed(self, spark: SparkSession, topic: str, group: str) -> dict[int, int]:
        """The last offset that a group has committed in each partition."""
        try:
            rows = spark.read.schema(f"{_POSITION}, batch int").parquet(f"{self.home}/_groups/{group}/{topic}")
        except AnalysisException:
            return {}
        return {r["part"]: r["offset"] for r in rows.groupBy("part").agg(F.max("offset").alias("offset")).collect()}

    def stream(self, rows: DataFrame, checkpoint: str, topic: str | None = None, **trigger) -> StreamingQuery:
        """A stream of records to the topics that they name, or to ``topic``; one append a batch."""
        named = rows if topic is None else rows.withColumn("topic", F.lit(topic))
        writer = named.writeStream.foreachBatch(lambda batch, number: self.put(batch, number))
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def _positions(spark: SparkSession, where: str) -> dict[int | None, int] | None:
    try:
        return {r["part"]: r["offset"] for r in spark.read.schema(_POSITION).parquet(where).collect()}
    except AnalysisException:
        return None


def kafka_start(topic: str, begin: str | dict[int | None, int]) -> dict[str, str]:
    """Kafka's options for a beginning: a word, or offsets by partition (which Kafka wants named in full)."""
    if isinstance(begin, dict):
        named = {str(p): o for p, o in begin.items() if p is not None}
        begin = json.dumps({topic: named}) if named else "earliest"
    return {"startingOffsets": begin}
