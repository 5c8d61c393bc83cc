"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule here: `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows without doc_id count as one document that comes after all others.
LAST_ID = 2**63 - 1
#: A key of more than one part in so many of all rows is hot: there are fewer of them than this.
HOT_PARTS = 4096
#: The folder of the innermost ``scratch``, if any.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one is set if all run on
    one machine, and else there is none to set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. Inside
    ``scratch`` the table goes when the block ends."""
    return _written(df, _folder(df.sparkSession))


def _folder(spark: SparkSession) -> str:
    return _FOLDER.get() or f"{shared_dir(spark)}/streamloom"


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``written`` writes inside goes when the block ends, also if it fails. What is still to be read
    afterwards is written by the function that the block gets, which keeps it as long as the code around does."""
    outer = _folder(spark)
    inner = f"{outer}/{uuid.uuid4().hex}"
    token = _FOLDER.set(inner)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _FOLDER.reset(token)
        where = spark._jvm.org.apache.hadoop.fs.Path(inner)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def joined_hot(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Written rows with the columns of ``table``, which has one row a key and says in ``n`` how many
    rows hold it. Hot keys (fewer than ``HOT_PARTS``) are broadcast, so their rows stay where they
    are read; the rest meet in a shuffle, in which no key has more than a small share."""
    hot = F.col("n") * HOT_PARTS > total
    few = F.broadcast(table.filter(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(table.filter(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def joined_salted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, salts: int = 64) -> DataFrame:
    """As ``joined_hot``, for a table that may have any number of rows a key, which no broadcast is sure to
    hold: only the hot keys themselves (fewer than ``HOT_PARTS``) are broadcast. A hot key's rows are dealt over
    ``salts`` parts, to each of which the table's rows of that key go."""
    hot = F.col("n") * HOT_PARTS > total
    known = F.broadcast(table.filter(hot).select(*keys).distinct())
    rest = rows.join(known, keys, "left_anti").join(table.filter(~hot), keys)
    dealt = rows.join(known, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    spread = table.filter(hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt").unionByName(rest)


def hash_pair(col: Column) -> tuple[Column, Column]:
    """128 bits as two longs from differently seeded 64-bit hashes, which group and sort cheaply."""
    return F.xxhash64(col), F.xxhash64(F.lit(1), col)


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; rows without an id count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def folded(col: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(col, UPPER, LOWER)


def packed(rows: DataFrame) -> DataFrame:
    """Rows of a text and its key (``did``, ``t1``, ``t2``), the text as a zstandard frame: a shuffle
    then moves half the bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        frames = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            made = [frames.compress((t.as_py() or "").encode()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["did", "t1", "t2", "packed"])

    return rows.mapInArrow(pack, "did long, t1 long, t2 long, packed binary")


def unpacked(frame: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(frame)
