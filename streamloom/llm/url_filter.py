"""URL filters: dated list entries become validity intervals; captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_salted, written

#: Bytes of the longest host name.
LONGEST = 253
_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without its port and final dot; null if there is none. What is
    longer than any name may be (``LONGEST``) is no host: its domains would be of quadratic size."""
    found = F.rtrim(F.regexp_extract(F.lower(url), _HOST, 1), F.lit("."))
    return F.when((found != "") & (F.octet_length(found) <= LONGEST), found)


def list_keys(url: Column, host: Column) -> Column:
    """What an entry that lists a URL can say, as an array of ``kind`` and ``value``: its host, itself
    without a fragment, and each domain that the host is in. Without a host the first is null and there are no domains."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.concat(
        F.array(key("host", host), key("url", F.regexp_replace(F.lower(url), "#.*$", ""))),
        F.coalesce(F.transform(domains, lambda d: key("domain", d)), F.array().cast("array<struct<kind:string,value:string>>")),
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated changes (``list``, ``kind``, ``value``, ``action``, ``at``) as intervals ``[since, until)``.

    An ``add`` holds until the next change of the same entry. Of changes at one time a ``remove``
    comes last; repeated rows count once. Rows with a null in any of these columns, and unknown kinds
    or actions, are no changes. Values are compared in lower case. An entry that is still listed has
    until null.
    """
    e = entries.select("list", "kind", F.lower("value").alias("value"), "action", "at").dropna()
    e = e.filter(F.col("kind").isin("host", "domain", "url") & F.col("action").isin("add", "remove")).distinct()
    by = Window.partitionBy("list", "kind", "value").orderBy("at", "action")
    e = e.withColumn("until", F.lead("at").over(by)).filter("action = 'add' and (until is null or until > at)")
    return e.select("list", "kind", "value", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge every capture (``page_id``, ``url``, ``fetched``) by the lists as they were when it was
    fetched: ``page_id``, ``url``, ``host``, ``fetched``, ``lists`` (sorted names), ``blocked``.

    Kinds: ``host`` (that host alone), ``domain`` (it and its subdomains), ``url`` (that URL without
    its fragment, in lower case). A URL's few possible keys are exploded and equi-joined with the
    intervals; the fetch time decides after the join. Equal captures are judged once, so a hot URL is
    one row; keys of very many captures (a large host, a top-level domain) are dealt over
    several tasks, and those keys' intervals to each of them (``joined_salted``).

    Null or relative URLs have no host and can match by ``url`` only; a null fetch time matches
    nothing. One row per input row. Empty lists block nothing; no captures give no rows.
    """
    c = captures.select("page_id", "url", "fetched").withColumn("host", host_of(F.col("url")))
    asked = c.filter("url is not null and fetched is not null").select("url", "host", "fetched").distinct()
    asked = asked.withColumn("key", F.explode(list_keys(F.col("url"), F.col("host")))).select("url", "fetched", "key.kind", "key.value").filter("value is not null")
    asked, names = written(asked), ["kind", "value"]
    v = written(validity_intervals(entries).join(asked.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names))
    hits = joined_salted(asked, v, names, asked.count()).filter("fetched >= since and (until is null or fetched < until)")
    hits = hits.groupBy("url", "fetched").agg(F.sort_array(F.collect_set("list")).alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    whole = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    rest = c.filter(~whole).withColumn("found", F.lit(None).cast("array<string>"))  # never meets a hit, and would be one task's
    return c.filter(whole).join(hits, ["url", "fetched"], "left").unionByName(rest).select("page_id", "url", "host", "fetched", found.alias("lists"), (F.size(found) > 0).alias("blocked"))
