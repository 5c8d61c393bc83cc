"""Change events: decoding, envelopes, filters, retraction and current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import apart, topic_parts
from ..schemas import CHANGE


def decode_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Debezium JSON as rows; anything unreadable fails the job, as it does at the source."""
    return apart(lines, F.from_json(column, CHANGE, {"mode": "FAILFAST"}))


def plain_envelope(changes: DataFrame, topic: str | None = None) -> DataFrame:
    """``database``, ``tableName``, ``before``, ``after``, ``type``: the database and table of the topic
    column, or of the source; missing images are empty; a creation is an insert."""
    db, table = topic_parts(F.col(topic)) if topic else (F.col("source.db"), F.col("source.table"))
    none = F.create_map().cast("map<string,string>")
    kind = F.when(F.col("op").isin("c", "create"), "insert").when(F.col("op") == "u", "update").when(F.col("op") == "d", "delete").when(F.col("op") == "r", "read").otherwise(F.lower("op"))
    return changes.select(db.alias("database"), table.alias("tableName"), F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"), kind.alias("type"))


def without_deletes(changes: DataFrame, op: str = "op", delete: str = "d") -> DataFrame:
    """A missing operation is no delete."""
    return changes.filter(~F.col(op).eqNullSafe(F.lit(delete)))


def retract(changes: DataFrame, op: str = "op", before: str = "before", after: str = "after", delete: str = "d", update: str = "u") -> DataFrame:
    """A changelog as (flag, image): old images are taken back, new ones put."""
    old = F.struct(F.lit(False).alias("flag"), F.col(before).alias("image"))
    new = F.struct(F.lit(True).alias("flag"), F.col(after).alias("image"))
    rows = F.when(F.col(op) == delete, F.array(old)).when(F.col(op) == update, F.array(old, new)).otherwise(F.array(new))
    return changes.withColumn("_r", F.explode(rows)).select(*[c for c in changes.columns if c not in (before, after)], "_r.flag", "_r.image")


def latest(changes: DataFrame, keys: list[str], order: list[str], op: str = "op", delete: str | None = "d") -> DataFrame:
    """The last row of each key, without keys whose last change deleted them (None: keep those)."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = changes.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
    return last if delete is None else without_deletes(last, op, delete)


def snapshot_feed(snapshot: DataFrame, marks: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """A table's rows and its log as one feed that begins with the table: ``keys``, ``op``, ``image``, ``pos``.

    The table is read chunk by chunk while it changes. ``snapshot`` has the ``keys``, the ``chunk`` and the ``image``
    that its read found; ``marks`` has for each chunk the log's position before the read (``low``) and after
    it (``high``); ``log`` has ``keys``, ``chunk``, ``pos``, ``op`` and ``image``. What the log says between a chunk's marks wins
    over what was read, as the read may have seen it or not. So a chunk's rows are as of its high mark (op
    ``r``), and only later log rows of its keys follow. Replaying the feed gives the table, whenever each
    read took place. Chunks are read and merged apart; nothing but their marks is known of all of them."""
    placed = log.join(marks, "chunk")
    during = placed.filter((F.col("pos") > F.col("low")) & (F.col("pos") <= F.col("high")))
    last = during.groupBy(*keys).agg(F.max_by(F.struct(F.col("op").alias("last_op"), F.col("image").alias("last_image")), "pos").alias("last"), F.max("high").alias("at"))
    both = snapshot.join(marks, "chunk").join(last, keys, "full_outer")
    image = F.when(F.col("last").isNull(), F.col("image")).otherwise(F.col("last.last_image"))
    rows = both.filter(~F.col("last.last_op").eqNullSafe("d")).select(*keys, F.lit("r").alias("op"), image.alias("image"), F.coalesce("at", "high").alias("pos"))
    return rows.unionByName(placed.filter(F.col("pos") > F.col("high")).select(*keys, "op", "image", "pos"))


def with_before(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A log that has new images only, with the ones before: of each key, the image of its change before. An
    insert of a key that is there is an update; updates and deletes of keys never seen keep what they have."""
    by = Window.partitionBy(*keys).orderBy(*order)
    past = F.struct(F.lag("after").over(by).alias("image"), F.lag("op").over(by).eqNullSafe("d").alias("gone"))
    rows = changes.withColumn("_past", past)
    known = F.when(~F.col("_past.gone"), F.col("_past.image"))
    op = F.when(F.col("op").isin("c", "r") & known.isNotNull(), "u").otherwise(F.col("op"))
    return rows.withColumns({"before": F.coalesce(known, F.col("before")), "op": op}).drop("_past")


def retracted_sums(flags: DataFrame, group: list[Column], value: Column) -> DataFrame:
    """Count and sum by group of a retraction stream (``flag``, ``image``): old images count negative. Groups that nothing is left of go."""
    sign = F.when(F.col("flag"), 1).otherwise(-1)
    sums = flags.groupBy(*group).agg(F.sum(sign).alias("n"), F.sum(sign * value).alias("total"))
    return sums.filter("n <> 0")
