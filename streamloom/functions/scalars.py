"""Scalar functions of the warehouse jobs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_TIME = "yyyy-MM-dd HH:mm:ss"
YEAR_MS = 86_400_000 * 365


def apart(rows: DataFrame, fields: Column | None = None, *keep: str) -> DataFrame:
    """The fields of a struct (by default all columns) as columns, after those to ``keep``, worked out once a row. Out
    of a plain select, filters and joins above take copies of the whole expression down to the scan: a
    document would be parsed again for each of their conditions."""
    return rows.select(*keep, F.inline(F.array(F.struct("*") if fields is None else fields)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def ymd_hms(ts: Column) -> Column:
    return F.date_format(ts, DATE_TIME)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def to_ms(text: Column, zone: str = "+08:00") -> Column:
    """Epoch milliseconds of a date-time text in a fixed zone; null if it can't be read."""
    return F.unix_millis(F.concat(text, F.lit(zone)).try_cast("timestamp"))


def parsed_ms(text: Column, fallback: Column, zone: str = "+00:00") -> Column:
    """As to_ms, but the record's own time where the text can't be read."""
    return F.coalesce(to_ms(text, zone), fallback)


def date_part(text: Column) -> Column:
    return F.try_element_at(F.split(text, " "), F.lit(1))


def hour_part(text: Column) -> Column:
    """The hour of a date-time text, as its two digits."""
    return F.try_element_at(F.split(F.try_element_at(F.split(text, " "), F.lit(2)), ":"), F.lit(1))


def age_years(birthday: Column, as_of: Column) -> Column:
    """Whole spans of 365 days, towards zero."""
    ms = F.timestamp_diff("MILLISECOND", birthday.cast("timestamp_ntz"), as_of.cast("timestamp_ntz"))
    return (ms / F.lit(YEAR_MS)).cast("int")


def is_empty(col: Column) -> Column:
    """Null or of no length."""
    return F.coalesce(F.length(col), F.lit(0)) == 0


def is_object(json: Column) -> Column:
    """Whether a text is a JSON object, never null."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))


def fields_of(doc: Column) -> Column:
    """The fields of a variant that is an object, by name; null for anything else."""
    return F.try_variant_get(doc, "$", "map<string,variant>")


def put_json(doc: Column, key: str, value: Column) -> Column:
    """A JSON object (variant) with one key set anew; what else it holds stays as it is."""
    return F.to_variant_object(put(fields_of(doc), key, value))


def put(m: Column, key: str, value: Column) -> Column:
    """A map with one key set anew."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def pruned(m: Column, columns: Column) -> Column:
    """Only the keys that a comma-separated list names, exactly as written."""
    names = F.split(columns, ",")
    return F.map_filter(m, lambda k, _: F.array_contains(names, k))


def plain_name(name: Column) -> Column:
    """A name without case and separators: ``user_name``, ``userName`` and ``UserName`` are one."""
    return F.lower(F.regexp_replace(name, "[_-]", ""))


def typed_json(text: Column, ddl: str) -> Column:
    """A JSON object as a struct of the DDL's fields. A field takes the key of its very name, or else one that is
    the same but for case and separators (of several, the last). What can't be read as the field's type
    is null, and so is the struct of what is no object."""
    kinds = T.StructType.fromDDL(ddl).fields

    def found(fields: Column, alike: Column) -> Column:
        key = lambda name: F.when(F.map_contains_key(fields, F.lit(name)), name).otherwise(alike[plain_name(F.lit(name))])
        return F.struct(*[F.try_variant_get(fields[key(f.name)], "$", f.dataType.simpleString()).alias(f.name) for f in kinds])

    def alike(fields: Column) -> Column:
        return F.aggregate(F.map_keys(fields), F.create_map().cast("map<string,string>"), lambda m, k: put(m, plain_name(k), k))

    return let(fields_of(F.try_parse_json(text)), lambda fields: F.when(fields.isNotNull(), let(alike(fields), lambda names: found(fields, names))))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(x.capitalize() for x in rest)


def topic_parts(topic: Column) -> tuple[Column, Column]:
    """Database and table of a change topic ``server.db.table``."""
    parts = F.split(topic, r"\.")
    return F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
