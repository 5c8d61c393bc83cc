"""Routing of change events by a configuration table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_empty, pruned

#: Configuration rows may name operations in words.
ALIASES = {"insert": "c", "update": "u", "delete": "d", "read": "r"}


def current_config(config: DataFrame, order: str = "ts_ms", aliases: bool = True) -> DataFrame:
    """One row for each source table and operation, the last one written by ``order``; defaults filled
    in. A table without that column has its key's only row (of several, one of the sink's names)."""
    op = F.col("operate_type")
    if aliases:
        op = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.lower(op)], op)
    rows = config.withColumns({"operate_type": op, "sink_pk": F.coalesce("sink_pk", F.lit("id")), "sink_extend": F.coalesce("sink_extend", F.lit(""))})
    written = [F.desc_nulls_last(order)] if order in config.columns else []
    by = Window.partitionBy("source_table", "operate_type").orderBy(*written, F.desc("sink_table"), F.desc("sink_type"))
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def matched(facts: DataFrame, config: DataFrame, table: str, op: str) -> DataFrame:
    """Facts with their configuration (null where none names them). Spark broadcasts the configuration
    where its own size check allows; the plan runs no job of its own."""
    keyed = config.withColumnsRenamed({"source_table": "_table", "operate_type": "_op"}).drop("ts_ms")
    return facts.join(keyed, (F.col(table) == F.col("_table")) & (F.col(op) == F.col("_op")), "left").drop("_op")


def route(facts: DataFrame, config: DataFrame, table: str = "table", op: str = "op", image: str = "after") -> dict[str, DataFrame]:
    """``kafka`` and ``hbase`` rows, their image pruned to the sink's columns, with ``sink_table``;
    ``unmatched`` facts without configuration. Other sink types are dropped, as none is served."""
    rows = matched(facts, config, table, op)
    known = rows.filter("_table is not null")
    cut = F.when(is_empty(F.col("sink_columns")), F.col(image)).otherwise(pruned(F.col(image), F.col("sink_columns")))
    known = known.withColumn(image, cut)
    extra = ["sink_type", "sink_columns", "_table"]
    return {
        "kafka": known.filter(F.lit("kafka") == F.col("sink_type")).drop(*extra),
        "hbase": known.filter(F.lit("hbase") == F.col("sink_type")).drop(*extra),
        "unmatched": rows.filter("_table is null").select(*facts.columns),
    }


def dim_schema(sink_columns: str | None, sink_pk: str | None = None) -> str:
    """The DDL of a dimension table: every column a string, the key (``id`` by default) not null. A
    configuration without columns leaves the key alone."""
    key = sink_pk or "id"
    names = list(dict.fromkeys([*(sink_columns or key).split(","), key]))
    return ", ".join(f"`{n}` string{' not null' if n == key else ''}" for n in names)


def extend_options(sink_extend: str | None) -> dict[str, str]:
    """What a configuration adds to a dimension's creation, as writer options: ``a=1, b=2``."""
    parts = (part.partition("=") for part in (sink_extend or "").replace(",", " ").split())
    return {name: value for name, _, value in parts if value}
