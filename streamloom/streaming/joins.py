"""Event-time joins and windows of streams, with the delays that keep what the jobs keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import FRESH, interval_join
from ..operators.stats import windowed

#: Rows up to a millisecond behind the newest are kept, as with a watermark that only rises.
RISING = "2 milliseconds"
#: Windows wait so long for late rows.
LATE = "11 seconds"
_SEEN = "l bigint, r bigint"


def configure(spark: SparkSession) -> None:
    """State in RocksDB, and late rows judged by the current watermark: one stateful operator a query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")


def joined_streams(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, before: str, after: str, delay: str = RISING, **bounds: bool) -> DataFrame:
    return interval_join(left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay), on, left_ts, right_ts, before, after, **bounds)


def start_joined(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, before: str, after: str, pairs: Callable[[DataFrame, DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None], checkpoint: str, delay: str = RISING, **trigger,
) -> StreamingQuery:
    """An interval join of two streams, batch by batch as a plain join: ``pairs`` joins two tables whose rows are
    marked ``FRESH`` or not, ``write`` gets the new pairs and the batch's number.

    The watermark is ``delay`` behind the newest row of the side that is behind. Rows at or before it come too late; rows
    that still can meet one after it wait for the next batch, as a table in the checkpoint's folder, in place of a
    state that takes in and loses each row by itself. A batch that runs again begins with what the one before left."""
    spark, home = left.sparkSession, f"{checkpoint.rstrip('/')}/waiting"
    none = [F.lit(None).cast(side.schema) for side in (left, right)]
    rows = left.select(F.struct("*").alias("l"), none[1].alias("r")).unionByName(right.select(none[0].alias("l"), F.struct("*").alias("r")))
    l_ts, r_ts = F.col(f"l.{left_ts}"), F.col(f"r.{right_ts}")

    def stored(some: DataFrame, name: str) -> DataFrame:
        some.write.mode("overwrite").parquet(f"{home}/{name}")
        return spark.read.schema(some.schema).parquet(f"{home}/{name}")

    def after_mark(time: Column, seen: tuple[int | None, int | None]) -> Column:
        """Whether a time is after the watermark; there is none until both sides have rows."""
        if None in seen:
            return time.isNotNull()
        return time > F.timestamp_micros(F.lit(min(seen))) - F.expr(f"interval {delay}")

    def step(batch: DataFrame, number: int) -> None:
        fresh = stored(batch, "fresh")  # parsed once, read for its pairs, its times and what waits
        seen, held = (None, None), fresh.limit(0)
        if number:
            seen = tuple(spark.read.schema(_SEEN).parquet(f"{home}/seen={number - 1}").first())
            held = spark.read.schema(rows.schema).parquet(f"{home}/rows={number - 1}")
        in_time = fresh.filter(after_mark(F.coalesce(l_ts, r_ts), seen))
        both = in_time.withColumn(FRESH, F.lit(True)).unionByName(held.withColumn(FRESH, F.lit(False)))
        made = pairs(*[both.filter(ts.isNotNull()).select(f"{side}.*", FRESH) for side, ts in (("l", l_ts), ("r", r_ts))])
        write(stored(made, "pairs"), number)
        newest = fresh.agg(F.unix_micros(F.max(l_ts)), F.unix_micros(F.max(r_ts))).first()
        now = tuple(max((t for t in times if t is not None), default=None) for times in zip(seen, newest))
        last = F.coalesce(l_ts + F.expr(f"interval {after}"), r_ts + F.expr(f"interval {before}"))
        stored(in_time.unionByName(held).filter(after_mark(last, now)), f"rows={number}")
        stored(spark.createDataFrame([now], _SEEN).coalesce(1), f"seen={number}")
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
        files = hadoop.Path(home).getFileSystem(conf)
        for old in ("fresh", "pairs", f"rows={number - 2}", f"seen={number - 2}"):
            files.delete(hadoop.Path(f"{home}/{old}"), True)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def windowed_stream(parts: list[DataFrame], ts: str, width: str = "10 seconds", dimensions: tuple[str, ...] = ("ar", "ch", "is_new", "vc"), delay: str = LATE) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return windowed([rows.withWatermark(ts, delay)], ts, width, dimensions)
