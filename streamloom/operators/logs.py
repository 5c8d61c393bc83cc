"""Application logs as whole documents: parsing, new-visitor repair and the split into topics.

A line is parsed once into a variant, fields are read from it by path, and what is written is the document
itself: every field that the jobs don't know, number and nested object goes through. Written documents
have their keys in code point order and no white space; arrays keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fields_of, put_json

#: The topics of the log job.
TOPICS = ("start", "page", "display", "dirty")


def split_dirty(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(JSON objects, everything else). Null, broken, and JSON that is no object are dirty."""
    good = fields_of(F.try_parse_json(column)).isNotNull()
    return lines.filter(good), lines.filter(~good)


def documents(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each line: ``raw``, the document ``doc``, ``mid``, ``is_new``, ``ts`` and ``kind``, and columns
    to ``keep``. The kind is ``start`` where ``start`` isn't empty, else ``page``; it is ``dirty`` for lines that are no
    object or repeat a key, have no ``common`` or neither ``start`` nor ``page``, or whose ``displays``
    are no array of objects: such lines would fail further on."""
    rows = lines.select(*keep, F.col(column).alias("raw"), F.try_parse_json(column).alias("doc"))
    path = lambda p, kind: F.try_variant_get("doc", f"$.{p}", kind)
    start, shown = path("start", "variant"), path("displays", "variant")
    started = start.isNotNull() & ~F.is_variant_null(start) & (F.to_json(start) != '""')
    items = path("displays", "array<variant>")
    whole = shown.isNull() | F.is_variant_null(shown) | F.coalesce(F.forall(items, lambda x: fields_of(x).isNotNull()), F.lit(False))
    usable = fields_of(path("common", "variant")).isNotNull() & (started | fields_of(path("page", "variant")).isNotNull()) & whole
    kind = F.when(~F.coalesce(usable, F.lit(False)), "dirty").when(started, "start").otherwise("page")
    found = {"mid": path("common.mid", "string"), "is_new": path("common.is_new", "string"), "ts": path("ts", "bigint"), "kind": kind}
    return rows.withColumns(found)


def repair_new_visitor(rows: DataFrame, key: str = "mid", flag: str = "is_new", order: tuple[str, ...] = ("ts",), known_counts: bool = False) -> DataFrame:
    """Batch form: of a device's rows flagged new only the first stays so. Rows flagged otherwise
    neither count nor change, unless ``known_counts`` makes an earlier one mark the device as known; nor
    do rows without a key."""
    new = F.coalesce((F.col(flag) == "1") & F.col(key).isNotNull(), F.lit(False))
    counts = F.col(key).isNotNull() if known_counts else new
    # rows that don't count are dealt out by themselves, so that a device of many rows isn't one task's
    apart = F.when(counts, F.lit(-1)).otherwise(F.pmod(F.hash(*order), F.lit(1 << 16)))
    first = F.row_number().over(Window.partitionBy(F.col(key), apart).orderBy(*order)) == 1
    return rows.withColumn(flag, F.when(new & ~first, "0").otherwise(F.col(flag)))


def records(docs: DataFrame, flag: Column) -> DataFrame:
    """What the log job writes: (``topic``, ``value``). A start log is one start record. Others are a page
    record, displays and all, and a display record for each element: the element with the page's id and
    nothing else of its parent. ``flag`` is put into ``common.is_new``, unless null. Dirty lines go as they are."""
    common = put_json(F.try_variant_get("doc", "$.common", "variant"), "is_new", flag.cast("variant"))
    doc = F.to_json(F.when(flag.isNotNull(), put_json(F.col("doc"), "common", common)).otherwise(F.col("doc")))
    page_id = F.try_variant_get("doc", "$.page.page_id", "variant")
    item = lambda x: F.to_json(F.when(page_id.isNotNull(), put_json(x, "page_id", page_id)).otherwise(x))
    one = lambda topic, value: F.struct(F.lit(topic).alias("topic"), value.alias("value"))
    shown = F.transform(F.coalesce(F.try_variant_get("doc", "$.displays", "array<variant>"), F.array().cast("array<variant>")), lambda x: one("display", item(x)))
    made = F.when(F.col("kind") == "page", F.concat(F.array(one("page", doc)), shown)).when(F.col("kind") == "start", F.array(one("start", doc))).otherwise(F.array(one("dirty", F.col("raw"))))
    return docs.select(F.inline(made))


def explode_items(rows: DataFrame, items: str, *keep: str) -> DataFrame:
    """A row for each element with its place; rows without elements go."""
    return rows.select(*keep, F.posexplode(items).alias("pos", "item"))
