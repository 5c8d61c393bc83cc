"""The warehouse operators as queries over the driver's tables, each with its DuckDB SQL.

The tables stand for the jobs' topics: a user is a device, a sign-up an entry page, and intervals are
hours or days where the jobs have seconds, as the rows lie that far apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import cdc, joins, logs, routing, stats, visits


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("select event_id, event_type, value from events where event_type is distinct from 'error'")
def filter_non_delete(spark, sf):
    return cdc.without_deletes(table(spark, sf, "events"), "event_type", "error").select("event_id", "event_type", "value")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_BROKEN = "case when event_id % 10 = 0 then left(props, length(props) - 1) else props end"


@query(f"with e as (select event_id, {_BROKEN} as value from events) select event_id, value from e where not json_valid(value)")
def dirty_split(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.expr(_BROKEN).alias("value"))
    return logs.split_dirty(lines)[1]


@query("select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, unnest(embedding)::double as item from embeddings")
def display_explode(spark, sf):
    return logs.explode_items(table(spark, sf, "embeddings"), "embedding", "vec_id").select("vec_id", "pos", F.col("item").cast("double").alias("item"))


@query(
    """select event_id, user_id, case when event_type = 'signup' and row_number() over (partition by user_id, event_type = 'signup' order by ts, event_id) > 1
    then '0' when event_type = 'signup' then '1' else '0' end as is_new from events"""
)
def new_visitor_fix(spark, sf):
    e = table(spark, sf, "events").withColumn("is_new", F.when(F.col("event_type") == "signup", "1").otherwise("0"))
    return logs.repair_new_visitor(e, "user_id", "is_new", ("ts", "event_id")).select("event_id", "user_id", "is_new")


@query(
    """with e as (select *, lag(ts::date) over (partition by user_id order by event_id) as before from events where event_type = 'signup')
    select event_id, user_id, strftime(ts, '%Y-%m-%d') as day from e where before is distinct from ts::date"""
)
def unique_visit_daily(spark, sf):
    rows = visits.unique_visits(table(spark, sf, "events"), F.col("event_type") == "signup", S.date_text(F.col("ts")), "user_id", ("event_id",))
    return rows.select("event_id", "user_id", S.date_text(F.col("ts")).alias("day"))


_JUMPS = """with n as (select *, lead(ts) over w as nts, lead(event_type = 'signup') over w as nentry from events window w as (partition by user_id order by ts, event_id)),
    j as (select * from n where event_type = 'signup' and (nts is null or nts >= ts + interval 6 hour or nentry))"""


@query(f"{_JUMPS} select event_id, user_id from j")
def user_jump(spark, sf):
    rows = visits.bounces(table(spark, sf, "events"), F.col("event_type") == "signup", "ts", "user_id", ("event_id",), "6 hours")
    return rows.select("event_id", "user_id")


@query(
    _JUMPS
    + """, u as (select *, lag(ts::date) over (partition by user_id order by event_id) as before from events where event_type = 'signup'),
    r as (select event_id, ts, event_type, 1 as uv, 0 as pv, 0 as sv, 0 as uj, 0 as dur from u where before is distinct from ts::date
      union all select event_id, ts, event_type, 0, 0, 0, 1, 0 from j
      union all select event_id, ts, event_type, 0, 1, (event_type = 'signup')::int, 0, coalesce(floor(value), 0)::bigint from events)
    select strftime(time_bucket(interval 6 hour, ts), '%Y-%m-%d %H:%M:%S') as stt, strftime(time_bucket(interval 6 hour, ts) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as edt,
      event_type, sum(uv)::bigint as uv_ct, sum(pv)::bigint as pv_ct, sum(sv)::bigint as sv_ct, sum(uj)::bigint as uj_ct, sum(dur)::bigint as dur_sum, arg_max(epoch_us(ts) // 1000, event_id) as ts
    from r group by stt, edt, event_type"""
)
def visitor_stats(spark, sf):
    """The greatest id arrives first here, so that ``ts`` is no least or greatest time."""
    e = table(spark, sf, "events").withColumn("arrived", -F.col("event_id"))
    entry, keep = F.col("event_type") == "signup", ["ts", "event_type", "arrived"]
    unique = visits.unique_visits(e, entry, S.date_text(F.col("ts")), "user_id", ("event_id",))
    jumps = visits.bounces(e, entry, "ts", "user_id", ("event_id",), "6 hours")
    page = stats.page_rows(e, keep, F.when(~entry, F.col("event_type")), F.floor("value"))
    return stats.windowed([stats.unique_rows(unique, keep), stats.jump_rows(jumps, keep), page], "ts", "6 hours", ("event_type",))


def _interval(spark, sf, **bounds):
    rows = joins.interval_join(table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "o_orderdate", "l_shipdate", "30 days", "30 days", **bounds)
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")


_INTERVAL = """select o_orderkey, o_custkey, o_orderdate, l_linenumber, l_partkey, l_shipdate, l_extendedprice from orders join lineitem on o_orderkey = l_orderkey
    and l_shipdate {0}= o_orderdate - interval 30 day and l_shipdate {1}= o_orderdate + interval 30 day"""


@query(_INTERVAL.format(">", "<"))
def order_wide(spark, sf):
    return _interval(spark, sf)


@query(_INTERVAL.replace("{0}=", ">").replace("{1}=", "<"))
def interval_pairs_exclusive(spark, sf):
    return _interval(spark, sf, lower_exclusive=True, upper_exclusive=True)


def _dims(spark, sf, missing=False):
    customer = table(spark, sf, "customer")
    return {"customer": customer.filter("c_custkey % 3 <> 0") if missing else customer, "nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}


_LOOKUPS = [
    joins.Lookup("customer", "c_custkey", "o_custkey", {"c_name": "c_name", "c_nationkey": "c_nationkey"}),
    joins.Lookup("nation", "n_nationkey", "c_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}),
    joins.Lookup("region", "r_regionkey", "n_regionkey", {"r_name": "r_name"}),
]


@query("select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dim_enrich(spark, sf):
    return joins.enrich(table(spark, sf, "orders"), _dims(spark, sf), _LOOKUPS).select("o_orderkey", "c_name", "n_name", "r_name")


@query("select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey and c_custkey % 3 <> 0 left join nation on c_nationkey = n_nationkey")
def dim_enrich_left(spark, sf):
    return joins.enrich(table(spark, sf, "orders"), _dims(spark, sf, True), _LOOKUPS[:2], "left").select("o_orderkey", "c_name", "n_name")


@query(
    """select p.event_id as payment_id, p.user_id, p.value as total_amount, w.event_id as order_event, w.ts as order_ts from events p join events w on p.user_id = w.user_id
    and p.event_type = 'purchase' and w.event_type = 'view' and w.ts >= p.ts - interval 6 hour and w.ts <= p.ts + interval 5 minute"""
)
def payment_wide(spark, sf):
    e = table(spark, sf, "events")
    p = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), "user_id", F.col("value").alias("total_amount"), F.col("ts").alias("p_ts"))
    w = e.filter("event_type = 'view'").select(F.col("event_id").alias("order_event"), F.col("user_id").alias("w_user"), F.col("ts").alias("order_ts"))
    rows = joins.interval_join(p, w, F.col("user_id") == F.col("w_user"), "p_ts", "order_ts", "6 hours", "5 minutes")
    return rows.select("payment_id", "user_id", "total_amount", "order_event", "order_ts")


_CONFIG = [("events", "click", "kafka", "dwd_click"), ("events", "view", "kafka", "dwd_view"), ("events", "purchase", "hbase", "dim_purchase"), ("events", "signup", "clickhouse", "ads_signup")]


@query(
    """with c(op, kind, sink_table) as (values ('click', 'kafka', 'dwd_click'), ('view', 'kafka', 'dwd_view'), ('purchase', 'hbase', 'dim_purchase'))
    select event_id, kind, sink_table from events join c on event_type = op"""
)
def config_route(spark, sf):
    values = ", ".join(str(row) for row in _CONFIG)
    config = spark.sql(f"select * from values {values} as c(source_table, operate_type, sink_type, sink_table)").withColumns({c: F.lit(None).cast("string") for c in ("sink_columns", "sink_pk", "sink_extend")})
    facts = table(spark, sf, "events").select("event_id", "event_type", F.lit("events").alias("table"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("after"))
    parts = routing.route(facts, routing.current_config(config), "table", "event_type")
    rows = parts["kafka"].withColumn("kind", F.lit("kafka")).unionByName(parts["hbase"].withColumn("kind", F.lit("hbase")))
    return rows.select("event_id", "kind", "sink_table")


@query("select event_id, user_id::varchar as user_id, event_type, null::varchar as value from events")
def column_prune(spark, sf):
    e = table(spark, sf, "events")
    image = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    rows = e.select("event_id", S.pruned(image, F.lit("user_id,event_type")).alias("after"))
    return rows.select("event_id", *[F.col("after")[c].alias(c) for c in ("user_id", "event_type", "value")])


@query(
    """with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
    select user_id, event_id, event_type from l where n = 1 and event_type is distinct from 'error'"""
)
def cdc_latest(spark, sf):
    return cdc.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "error").select("user_id", "event_id", "event_type")


@query(
    """select event_id, false as flag, value - 1 as image from events where event_type in ('error', 'click')
    union all select event_id, true, value from events where event_type is distinct from 'error'"""
)
def retract_stream(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", (F.col("value") - 1).alias("before"), F.col("value").alias("after"))
    return cdc.retract(e, "event_type", "before", "after", "error", "click").select("event_id", "flag", "image")


@query("select o_orderkey, trunc((epoch_ms(timestamp '2024-01-01') - epoch_ms(o_orderdate)) / 31536000000.0)::int as age from orders")
def age_years(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.age_years(F.col("o_orderdate"), F.lit("2024-01-01")).alias("age"))


@query(
    """with e as (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as create_time, ts from events)
    select event_id, create_time, split_part(create_time, ' ', 1) as create_date, split_part(split_part(create_time, ' ', 2), ':', 1) as create_hour, (epoch_us(ts) // 1000)::bigint as ms from e"""
)
def date_parts(spark, sf):
    e = table(spark, sf, "events").select("event_id", S.ymd_hms(F.col("ts")).alias("create_time"), S.epoch_ms(F.col("ts")).alias("ms"))
    return e.select("event_id", "create_time", S.date_part(F.col("create_time")).alias("create_date"), S.hour_part(F.col("create_time")).alias("create_hour"), "ms")


@query(
    """with a as (select event_id, event_type, value from events where event_type in ('click', 'view')), b as (select event_id, event_type, value * 2 as value from events where event_type in ('view', 'error'))
    select coalesce(a.event_id, b.event_id) as event_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(a.value, b.value) as value from a full join b on a.event_id = b.event_id"""
)
def coalesce_merge(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    a, b = e.filter("event_type in ('click', 'view')"), e.filter("event_type in ('view', 'error')").withColumn("value", F.col("value") * 2)
    return joins.merged_orders(a, b, ["event_id"])


@query(
    """with a as (select event_id, event_type, 'page' as kind from events where event_type = 'view' union all select event_id, event_type, 'start' from events where event_type = 'signup')
    select event_id, event_type, kind from a"""
)
def log_split(spark, sf):
    raw = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("mid")).alias("common"), F.when(F.col("event_type") == "signup", "icon").alias("start"), F.when(F.col("event_type") == "view", F.struct(F.col("event_type").alias("page_id"))).alias("page"), F.col("event_id").alias("ts")))
    docs = logs.documents(table(spark, sf, "events").select(raw.alias("value")))
    kind = F.when(F.col("kind") == "start", "signup").otherwise(F.try_variant_get("doc", "$.page.page_id", "string"))
    return docs.filter("kind <> 'dirty'").select(F.col("ts").alias("event_id"), kind.alias("event_type"), "kind")
