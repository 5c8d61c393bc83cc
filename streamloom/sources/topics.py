"""Sources: topics, change feeds, sockets, JDBC tables and CSV lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import camel
from ..operators.cdc import decode_changes, latest, without_deletes


def read_topic(spark: SparkSession, where: str, streaming: bool = False, servers: str | None = None, files_per_batch: int | None = None, group: str | None = None) -> DataFrame:
    """Text records of a topic as ``value``. With ``servers`` it is a Kafka topic (the connector must
    be on the class path); without, a directory of line files stands for it."""
    reader = spark.readStream if streaming else spark.read
    if servers:
        reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", where)
        if group:
            reader = reader.option("kafka.group.id", group)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format("text").load(where).select("value")


def change_rows(lines: DataFrame, tables: list[str] | None = None, startup: str = "latest") -> DataFrame:
    """Lines of a change feed as rows. ``startup='latest'`` leaves the snapshot's reads out, ``'initial'`` keeps
    them; no ``tables`` means all. Where the feed begins is for the topic to say (``records.Topics.read``)."""
    rows = decode_changes(lines)
    if startup == "latest":
        rows = rows.filter(~F.col("op").eqNullSafe("r"))
    return rows.filter(F.concat_ws(".", "source.db", "source.table").isin(tables)) if tables else rows


def read_changes(spark: SparkSession, where: str, streaming: bool = False, tables: list[str] | None = None, startup: str = "latest", **options) -> DataFrame:
    """A change feed of line files or of Kafka as rows."""
    return change_rows(read_topic(spark, where, streaming, **options), tables, startup)


def changelog_view(changes: DataFrame, name: str, schema: T.StructType, keys: list[str] | None = None, order: tuple[str, ...] = ("ts_ms",)) -> None:
    """A change feed as a typed SQL view: what a connector's table declares. With the ``keys`` of the
    declared table, its rows as the feed leaves them; without, every new image. Deletes show nothing."""
    if keys:
        image = F.coalesce("after", "before")
        changes = latest(changes.withColumns({f"_k{i}": image[k] for i, k in enumerate(keys)}), [f"_k{i}" for i in range(len(keys))], list(order))
    rows = without_deletes(changes)
    rows.select(*[F.col("after")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).createOrReplaceTempView(name)


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def csv_rows(lines: DataFrame, ddl: str, seconds: str | None = None, column: str = "value") -> DataFrame:
    """CSV lines as rows; a column of epoch seconds becomes a timestamp."""
    rows = lines.select(F.from_csv(column, ddl).alias("r")).select("r.*")
    return rows.withColumn(seconds, F.timestamp_seconds(seconds)) if seconds else rows


def read_jdbc(spark: SparkSession, url: str, query: str, to_camel: bool = False, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A JDBC query as rows, column names in lower camel case if wanted. With a ``key``, a column of whole numbers
    as the database writes its name, the query is read in ``parts`` tasks: the database says the least and
    the greatest key, and each task asks for its range; the first takes rows without a key too."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        rows = reader.option("query", query).load()
    else:
        ends = reader.option("query", f"select min({key}) as lo, max({key}) as hi from ({query}) q").load().first()
        low, high = (0, 0) if ends[0] is None else (int(ends[0]), int(ends[1]))
        cuts = sorted({low + (high - low + 1) * i // parts for i in range(1, parts)} - {low})
        bounds = [*zip([None, *cuts], [*cuts, None])]
        ranges = [" and ".join(([f"{key} >= {a}"] if a is not None else []) + ([f"{key} < {b}"] if b is not None else [])) or "1 = 1" for a, b in bounds]
        if cuts:
            ranges[0] = f"({ranges[0]} or {key} is null)"
        rows = spark.read.jdbc(url, f"({query}) q", predicates=ranges, properties=options)
    return camel_columns(rows) if to_camel else rows


def camel_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: camel(c) for c in rows.columns})
