"""Dimension tables that are read and merged by bucket, in versions.

A table's rows lie in buckets by the hash of their key. A batch of changes rewrites the buckets that its keys
fall into and no others, then a new manifest says which batch wrote each bucket last. Readers take one
manifest, so they see one version however long they read; a batch that runs again replaces its own files.
Old versions stay until ``vacuum`` takes them away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table. For one of many millions of rows, thousands keep a bucket small.
BUCKETS = 16
_ROW = "key string, after map<string,string>, at bigint, sink_table string, bucket int"
_MANIFEST = "sink_table string, bucket int, batch bigint"


@dataclass(frozen=True)
class DimStore:
    """All dimensions below ``home``; ``buckets`` of each table must stay as they were when it was made."""

    home: str
    buckets: int = BUCKETS

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        """The batches that have left a manifest, oldest first."""
        try:
            rows = spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{self.home}/manifests").select("version").distinct()
        except AnalysisException:
            return []
        return sorted(r["version"] for r in rows.collect())

    def manifest(self, spark: SparkSession, version: int | None = None, before: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> the batch whose file holds it, as of a version: one entry a bucket, at most
        ``buckets`` for each table of the configuration."""
        known = [v for v in self.versions(spark) if (version is None or v <= version) and (before is None or v < before)]
        if not known:
            return {}
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.home}/manifests/version={known[-1]}").collect()
        return {(r["sink_table"], r["bucket"]): r["batch"] for r in rows}

    def _stored(self, spark: SparkSession, places: list[tuple[str, int, int]]) -> DataFrame:
        if not places:
            return spark.createDataFrame([], _ROW)
        paths = [f"{self.home}/data/batch={batch}/sink_table={table}/bucket={bucket}" for table, bucket, batch in places]
        rows = spark.read.schema(f"{_ROW}, batch bigint").option("basePath", f"{self.home}/data").parquet(*paths)
        return rows.select("key", "after", "at", "sink_table", "bucket")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Routed changes (``sink_table``, ``sink_pk``, ``after``, ``ts_ms``) into their tables: of each key the last
        change of the batch replaces what is there. Only the buckets of the batch's keys are read and written;
        which these are comes to the driver."""
        spark = rows.sparkSession
        keyed = rows.select("sink_table", F.col("after")[F.coalesce("sink_pk", F.lit("id"))].alias("key"), "after", F.col("ts_ms").alias("at"))
        last = F.max_by(F.struct("after", "at"), F.struct("at", F.to_json("after"))).alias("last")
        new = keyed.groupBy("sink_table", "key").agg(last).select("sink_table", "key", "last.*").withColumn("bucket", self.bucket(F.coalesce("key", F.lit(""))))
        touched = [(r["sink_table"], r["bucket"]) for r in new.select("sink_table", "bucket").distinct().collect()]
        if not touched:
            return
        held = self.manifest(spark, before=batch)
        old = self._stored(spark, [(*t, held[t]) for t in touched if t in held])
        both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        now = both.groupBy("sink_table", "bucket", "key").agg(F.max_by(F.struct("after", "at"), "new").alias("last"))
        now = now.select("key", "last.after", "last.at", "sink_table", "bucket").repartition("sink_table", "bucket")
        now.write.mode("overwrite").partitionBy("sink_table", "bucket").parquet(f"{self.home}/data/batch={batch}")
        entries = [(*t, b) for t, b in (held | {t: batch for t in touched}).items()]
        spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/manifests/version={batch}")

    def vacuum(self, spark: SparkSession, keep: int = 10) -> int:
        """Delete all versions but the last ``keep``, and the bucket files that none of these names; returns how many
        of them went. Files of batches after the last version stay, as they may be being written. Readers of older
        versions must be done. A batch that runs again needs the version before its own, so two are the least."""
        if keep < 2:
            raise ValueError("keep at least two versions: the last batch may run again")
        versions = self.versions(spark)
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        # manifests first: a file that is gone is then named by no version
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
        files = hadoop.Path(self.home).getFileSystem(conf)
        for version in old:
            files.delete(hadoop.Path(f"{self.home}/manifests/version={version}"), True)
        named = {(batch, *place) for v in kept for place, batch in self.manifest(spark, v).items()}
        gone = 0
        for status in files.globStatus(hadoop.Path(f"{self.home}/data/batch=*/sink_table=*/bucket=*")):
            path = status.getPath()
            table, batch = path.getParent(), path.getParent().getParent()
            number, name, bucket = (unquote(p.getName().partition("=")[2]) for p in (batch, table, path))
            if int(number) <= kept[-1] and (int(number), name, int(bucket)) not in named:
                files.delete(path, True)
                gone += 1
        return gone

    def read(self, spark: SparkSession, table: str, columns: list[str], keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """A table's ``columns``, whole, or only the buckets that ``keys`` (one column) fall into."""
        return self._read(spark, self.manifest(spark, version), table, columns, keys)

    def reader(self, spark: SparkSession) -> Callable[[str, list[str], DataFrame | None], DataFrame]:
        """``read`` for several tables as of one version, that which is the last now."""
        held = self.manifest(spark)
        return lambda table, columns, keys=None: self._read(spark, held, table, columns, keys)

    def _read(self, spark: SparkSession, held: dict[tuple[str, int], int], table: str, columns: list[str], keys: DataFrame | None) -> DataFrame:
        own = {b: batch for (t, b), batch in held.items() if t == table}
        if keys is not None:
            key = F.coalesce(F.col(keys.columns[0]).cast("string"), F.lit(""))
            needed = {r["b"] for r in keys.select(self.bucket(key).alias("b")).distinct().collect()}
            own = {b: batch for b, batch in own.items() if b in needed}
        rows = self._stored(spark, [(table, b, batch) for b, batch in own.items()])
        return rows.select(*[F.col("after")[c].alias(c) for c in columns])
