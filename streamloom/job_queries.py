"""The jobs as queries over the driver's tables, from records in topics to what they write, each with its DuckDB SQL.

The tables are first written as the topics that the jobs read; streams then run over these to their
end, and the query returns what stands at the sink. Orders and line items are days apart, so joins
take days where the jobs take seconds.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas, sinks
from .catalogue import query, table
from .dims import DimStore
from .functions import scalars as S
from .operators import cdc, joins, logs, routing, stats
from .plans import jobs
from .records import Topics
from .sources import topics
from .streaming import fanout
from .streaming import jobs as streams
from .streaming import joins as sj
from .streaming import stateful

AS_OF = "2024-01-01"


def home(spark: SparkSession) -> str:
    """A new folder where driver and executors both see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{shared.rstrip('/')}/streamloom/{uuid.uuid4().hex}"


def stream_session(spark: SparkSession, stateful: bool = True) -> SparkSession:
    """A session for streams: their settings stay out of the caller's. State stores are as many as tasks run at once."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    if stateful:
        session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
        sj.configure(session)
    return session


def topic(rows: DataFrame, where: str) -> str:
    """Rows as a topic of JSON lines; its folder."""
    sinks.write_topic(rows, where)
    return where


def _when(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _at(rows: DataFrame, time, some: str) -> DataFrame:
    """Rows whose time fits a condition on ``create_time``, before it is made a text."""
    return rows.withColumn("create_time", time.cast("timestamp_ntz")).filter(some)


def _orders(spark, sf, some: str = "true") -> DataFrame:
    amount = F.col("o_totalprice").cast(schemas.DEC)
    return _at(table(spark, sf, "orders"), F.col("o_orderdate"), some).select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("province_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        amount.alias("total_amount"), amount.alias("original_total_amount"), F.lit(None).cast(schemas.DEC).alias("feight_fee"), _when("o_orderdate").alias("create_time"),
    )


def _details(spark, sf, some: str = "true") -> DataFrame:
    price = F.col("l_extendedprice").cast(schemas.DEC)
    return _at(table(spark, sf, "lineitem"), F.col("l_shipdate"), some).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.lit("old").alias("sku_name"),
        price.alias("order_price"), F.col("l_quantity").cast("long").alias("sku_num"), price.alias("split_total_amount"), _when("l_shipdate").alias("create_time"),
    )


def _dims(spark, sf, some: str = "true") -> dict[str, DataFrame]:
    t = lambda name: table(spark, sf, name)
    return {
        "DIM_USER_INFO": t("customer").filter(some).selectExpr("string(c_custkey) as ID", "c_mktsegment as GENDER", "string(date_add(date '1960-01-01', int(c_custkey % 15000))) as BIRTHDAY"),
        "DIM_BASE_PROVINCE": t("nation").selectExpr("string(n_nationkey) as ID", "n_name as NAME", "string(n_regionkey) as AREA_CODE", "concat('N', n_nationkey) as ISO_CODE", "concat('X', n_nationkey) as ISO_3166_2"),
        "DIM_SKU_INFO": t("part").selectExpr("string(p_partkey) as ID", "p_name as SKU_NAME", "string(p_size % 25) as CATEGORY3_ID", "string(p_partkey % 10) as SPU_ID", "string(p_partkey % 5) as TM_ID"),
        "DIM_SPU_INFO": t("supplier").selectExpr("string(s_suppkey) as ID", "s_name as SPU_NAME"),
        "DIM_BASE_TRADEMARK": t("region").selectExpr("string(r_regionkey) as ID", "r_name as TM_NAME"),
        "DIM_BASE_CATEGORY3": t("nation").selectExpr("string(n_nationkey) as ID", "n_name as NAME"),
    }


_AMOUNTS = ["total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "order_price", "split_total_amount", "split_activity_amount", "split_coupon_amount", "split_feight_fee"]


def _plain(rows: DataFrame) -> DataFrame:
    """Amounts as doubles, for comparison."""
    return rows.withColumns({c: F.col(c).cast("double") for c in _AMOUNTS if c in rows.columns})


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_PAIRS = f"""o as (select o_orderkey as id, (o_custkey % 25)::bigint as province_id, o_orderstatus as order_status, o_custkey as user_id, o_totalprice as amount, {_TIME.format("o_orderdate")} as create_time, o_orderdate as at from orders),
    d as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as order_id, l_partkey as sku_id, l_extendedprice as price, l_quantity::bigint as sku_num, l_shipdate as at from lineitem),
    p as (select o.id as order_id, province_id, order_status, user_id, amount as total_amount, null::double as activity_reduce_amount, null::double as coupon_reduce_amount, amount as original_total_amount,
      null::double as feight_fee, create_time, split_part(create_time, ' ', 1) as create_date, split_part(split_part(create_time, ' ', 2), ':', 1) as create_hour, d.id as detail_id, sku_id, price as order_price, sku_num,
      price as split_total_amount, null::double as split_activity_amount, null::double as split_coupon_amount, null::double as split_feight_fee, null::varchar as expire_time, null::varchar as operate_time
      from o join d on o.id = d.order_id and d.at >= o.at - interval 30 day and d.at <= o.at + interval 30 day)"""
_WIDE = """select p.*, c_mktsegment as user_gender, trunc((epoch_ms(timestamp '2024-01-01') - epoch_ms((date '1960-01-01' + (c_custkey % 15000)::int)::timestamp)) / 31536000000.0)::int as user_age,
    n.n_name as province_name, n.n_regionkey::varchar as province_area_code, 'N' || n.n_nationkey as province_iso_code, 'X' || n.n_nationkey as province_3166_2_code, p_name as sku_name,
    (p_size % 25)::varchar as category3_id, (p_partkey % 10)::varchar as spu_id, (p_partkey % 5)::varchar as tm_id, s_name as spu_name, r_name as tm_name, c3.n_name as category3_name
    from p {0} join customer on user_id = c_custkey{1} {0} join nation n on province_id = n.n_nationkey {0} join part on sku_id = p_partkey
    {0} join supplier on s_suppkey = p_partkey % 10 {0} join region on r_regionkey = p_partkey % 5 {0} join nation c3 on c3.n_nationkey = p_size % 25"""


@query(f"with {_PAIRS} {_WIDE.format('', '')}")
def order_wide_rows(spark, sf):
    """Order and detail topics to enriched rows, with all six lookups."""
    where = home(spark)
    read = lambda rows, name: topics.read_topic(spark, topic(rows, f"{where}/{name}"))
    return _plain(jobs.order_wide(read(_orders(spark, sf), "orders"), read(_details(spark, sf), "details"), _dims(spark, sf), F.lit(AS_OF), slack="30 days"))


@query(f"with {_PAIRS} {_WIDE.format('left', ' and c_custkey % 3 <> 0')}")
def order_wide_rows_left(spark, sf):
    """Facts without a dimension row stay."""
    lines = [sinks.encoded(rows) for rows in (_orders(spark, sf), _details(spark, sf))]
    return _plain(jobs.order_wide(*lines, _dims(spark, sf, "c_custkey % 3 <> 0"), F.lit(AS_OF), "left", "30 days"))


def _payments(spark, sf, some: str = "true") -> DataFrame:
    paid = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 20).cast("int"))
    return _at(table(spark, sf, "orders"), paid, some).select(
        (F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1).alias("user_id"),
        F.floor(F.col("o_totalprice")).cast(schemas.DEC).alias("total_amount"), F.lit("s").alias("subject"), F.lit("1101").alias("payment_type"), F.date_format(paid, "yyyy-MM-dd HH:mm:ss").alias("create_time"),
    )


_PAID = f"""with {_PAIRS} select o_orderkey + 1000000000 as payment_id, {_TIME.format("o_orderdate + to_minutes(o_orderkey % 20)")} as payment_create_time, p.create_time as order_create_time, o_orderkey as order_id,
    case when o_orderkey % 2 = 0 then o_custkey + 1 end as user_id, floor(o_totalprice) as total_amount, 's' as subject, '1101' as payment_type, null::varchar as callback_time, 'old' as sku_name, p.* exclude (order_id, user_id, total_amount, create_time)
    from orders join p on order_id = o_orderkey where o_orderkey % 20 <= 15"""


@query(_PAID)
def payment_wide_rows(spark, sf):
    """Payments win over the order's values of the same name, null or not."""
    wides = jobs.order_pairs(sinks.encoded(_orders(spark, sf)), sinks.encoded(_details(spark, sf)), "30 days")
    return _plain(jobs.payment_wide(sinks.encoded(_payments(spark, sf)), wides))


#: Events as log lines, in SQL of both engines: sign-ups start, errors are broken, views have two displays. Fields
#: that no job knows, nested ones and numbers of all kinds, stand at every level, keys in no order.
_LINE = """'{"ts":' || event_id || ',"common":{"mid":"' || user_id || '","is_new":"' || case when event_type in ('signup', 'view') then '1' else '0' end || '","vc":"v1","uid":' || user_id || ',"os":{"v":[2.50,1],"name":"n"},"ch":"c","ar":"' || event_type || '"},'
    || case when event_type = 'signup' then '"start":{"ms":12.50,"entry":"icon"}' else '"page":{"page_id":"' || event_type || '","item":{"price":' || event_id || ',"id":"i"},"during_time":' || user_id || '}' end
    || case when event_type = 'view' then ',"displays":[{"pos":1,"item":"' || event_id || 'a","more":{"b":null,"a":[true]}},{"item":"' || event_id || 'b","pos":2}]' else '' end || ',"err":{"code":1.0E2}}'"""
_LOGGED = f"case when event_type = 'error' then left({_LINE}, 20) else {_LINE} end"
_SHOWN = """'{"item":"' || event_id || 'a","more":{"a":[true],"b":null},' || p || '"pos":1}'""", """'{"item":"' || event_id || 'b",' || p || '"pos":2}'"""
_RECORDS = f"""l as (select *, case when event_type in ('signup', 'view') and row_number() over (partition by user_id, event_type in ('signup', 'view') order by event_id) = 1 then '1' else '0' end as flag from events where event_type <> 'error')
    select case when event_type = 'signup' then 'start' else 'page' end as topic, '{{"common":{{"ar":"' || event_type || '","ch":"c","is_new":"' || flag || '","mid":"' || user_id || '","os":{{"name":"n","v":[2.5,1]}},"uid":' || user_id || ',"vc":"v1"}},'
      || case when event_type = 'view' then '"displays":[' || {_SHOWN[0]} || ',' || {_SHOWN[1]} || '],' else '' end || '"err":{{"code":100.0}},'
      || case when event_type = 'signup' then '"start":{{"entry":"icon","ms":12.5}},' else '"page":{{"during_time":' || user_id || ',"item":{{"id":"i","price":' || event_id || '}},"page_id":"' || event_type || '"}},' end || '"ts":' || event_id || '}}' as value from l, (select '' as p)
    union all select 'display', {_SHOWN[0]} from events, (select '"page_id":"view",' as p) where event_type = 'view'
    union all select 'display', {_SHOWN[1]} from events, (select '"page_id":"view",' as p) where event_type = 'view'
    union all select 'dirty', {_LOGGED} from events where event_type = 'error'"""
LOG_TOPICS = logs.TOPICS


def _logs(spark, sf, some: str = "true") -> DataFrame:
    return table(spark, sf, "events").filter(some).select(F.expr(_LOGGED).alias("value"))


def _read_all(spark, out: Topics, names) -> DataFrame:
    """Several topics as one table (``topic``, ``value``)."""
    found = [out.read(spark, n).select(F.lit(n).alias("topic"), "value") for n in names]
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    return found[0]


def _parts(spark, sf, name: str, ts: str, n: int, text: str | None = None) -> list[str]:
    """Conditions that cut a table's rows into ``n`` parts by time, or rows by the time in a ``text`` column."""
    low, high = table(spark, sf, name).agg(F.min(F.col(ts).cast("timestamp_ntz")), F.max(F.col(ts).cast("timestamp_ntz"))).first()
    cuts = [] if low is None else [(low + (high - low) * i / n).replace(microsecond=0) for i in range(1, n)]
    literal = [f"'{c}'" if text else f"timestamp_ntz'{c}'" for c in cuts]
    at = text or ts
    bounds = zip([None, *literal], [*literal, None])
    return [" and ".join(([f"{at} >= {lo}"] if lo else []) + ([f"{at} < {hi}"] if hi else [])) or "true" for lo, hi in bounds]


@query("select event_id::varchar || x as item, 'view' as page_id from events, (values ('a'), ('b')) as v(x) where event_type = 'view'")
def display_rows(spark, sf):
    """A display record for each element, as it stands in its topic."""
    rows = jobs.base_log(_logs(spark, sf))["display"]
    return rows.select(F.get_json_object("value", "$.item").alias("item"), F.get_json_object("value", "$.page_id").alias("page_id"))


@query(f"with {_RECORDS}")
def base_log_job(spark, sf):
    """The log job in batch form, to its four topics and back: whole records."""
    out = Topics(home(spark))
    jobs.run_base_log(_logs(spark, sf), out)
    return _read_all(spark, out, LOG_TOPICS)


@query(f"with {_RECORDS}")
def stream_base_log(spark, sf):
    """The same as a stream that is started three times, from where the last start ended; flags by keyed state."""
    where, session = home(spark), stream_session(spark)
    lines, out = Topics(f"{where}/in"), Topics(f"{where}/out")
    for some in _thirds(spark, sf):
        lines.put(_logs(spark, sf, some).withColumn("topic", F.lit("ods_base_log")))
        fanout.start_base_log(lines.read(session, "ods_base_log", True), out, f"{where}/ck").awaitTermination()
    return _read_all(spark, out, LOG_TOPICS)


def _thirds(spark, sf) -> list[str]:
    """Conditions that cut the events into three parts by id, the order in which the log lines are numbered."""
    third = (table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0) // 3
    return [f"event_id < {third}", f"event_id >= {third} and event_id < {third * 2}", f"event_id >= {third * 2}"]


def _changes(spark, sf, some: str = "true") -> DataFrame:
    """Events as changes of a user's row, one feed for two tables; errors are deletes, clicks updates."""
    e, kind, text = table(spark, sf, "events").filter(some), F.col("event_type"), lambda c: F.col(c).cast("string")
    image = F.create_map(F.lit("id"), text("user_id"), F.lit("last"), text("event_id"), F.lit("kind"), kind)
    old = F.create_map(F.lit("id"), text("user_id"))
    op = F.when(kind == "error", "d").when(kind == "click", "u").when(kind == "signup", "r").otherwise("c")
    name = F.when(kind == "purchase", "order_info").otherwise("user_info")
    source = F.struct(F.lit("shop").alias("db"), name.alias("table"), F.col("event_id").alias("ts_ms"))
    return e.select(F.when(kind.isin("error", "click"), old).alias("before"), F.when(kind != "error", image).alias("after"), source.alias("source"), op.alias("op"), F.col("event_id").alias("ts_ms"))


@query("with m as (select max(event_id) // 3 as third from events) select event_id as ts_ms, 'user_info' as name, case event_type when 'error' then 'd' when 'click' then 'u' else 'c' end as op, case when event_type in ('error', 'click') then user_id::varchar end as old_id, case when event_type <> 'error' then event_id::varchar end as new_last from events, m where event_type not in ('signup', 'purchase') and event_id >= third")
def change_feed(spark, sf):
    """A feed of one table from the position that it had when a group first asked for the latest: what was
    there before isn't read, what came later is, however often the group starts."""
    where, out = home(spark), Topics(home(spark))
    for some in _thirds(spark, sf):
        out.put(sinks.encoded(_changes(spark, sf, some)).withColumn("topic", F.lit("ods_base_db")))
        feed = out.read(spark, "ods_base_db", start="latest", pin=f"{where}/begin")
    rows = topics.change_rows(feed, tables=["shop.user_info"])
    return rows.select("ts_ms", F.col("source.table").alias("name"), "op", F.col("before")["id"].alias("old_id"), F.col("after")["last"].alias("new_last"))


@query("select event_id, 'shop' as \"database\", 'user_info' as tableName, case event_type when 'error' then 'delete' when 'click' then 'update' when 'signup' then 'read' else 'insert' end as \"type\", case when event_type = 'error' then 0 else 3 end as n_after, case when event_type in ('error', 'click') then 1 else 0 end as n_before from events")
def change_envelope(spark, sf):
    """The plain envelope, database and table out of the topic's name."""
    changes = cdc.decode_changes(sinks.encoded(_changes(spark, sf))).withColumn("topic", F.lit("mysql.shop.user_info"))
    rows = cdc.plain_envelope(changes.withColumn("before", F.map_concat(F.coalesce("before", F.create_map().cast("map<string,string>")), F.create_map(F.lit("ts"), F.col("ts_ms").cast("string")))), "topic")
    return rows.select(F.col("before")["ts"].cast("long").alias("event_id"), "database", "tableName", "type", F.size("after").alias("n_after"), (F.size("before") - 1).alias("n_before"))


_CONFIG = "values ('user_info', 'insert', 'hbase', 'dim_user', 'id,last', 2), ('user_info', 'insert', 'kafka', 'old', 'id', 1), ('user_info', 'update', 'hbase', 'dim_user', 'id,last', 1), ('user_info', 'r', 'kafka', 'dwd_user', null, 1) as c(source_table, operate_type, sink_type, sink_table, sink_columns, ts_ms)"


def _config(spark) -> DataFrame:
    return spark.sql(f"select *, string(null) as sink_pk, string(null) as sink_extend from {_CONFIG}")


_DIM = "select user_id::varchar as id, max(event_id)::varchar as last from events where event_type in ('click', 'view') group by user_id"
_ROUTED = """select 'dwd_user' as topic, user_id::varchar as id, event_id::varchar as last, event_type as kind from events where event_type = 'signup'
    union all select 'unmatched', user_id::varchar, event_id::varchar, event_type from events where event_type = 'purchase'"""


@query(_DIM)
def dimension_upsert(spark, sf):
    """The change job's dimension: created from the configuration, of each key the last change."""
    where = home(spark)
    jobs.base_db(spark, sinks.encoded(_changes(spark, sf)), _config(spark), Topics(f"{where}/topics"), f"{where}/dims")
    return sinks.dim_now(spark, f"{where}/dims", "dim_user")


@query(_ROUTED)
def routed_topics(spark, sf):
    """The change job's topics, chosen record by record, and the facts that no configuration names."""
    where, out = home(spark), Topics(f"{home(spark)}/topics")
    left = jobs.base_db(spark, sinks.encoded(_changes(spark, sf)), _config(spark), out, f"{where}/dims")
    return _routed(out.read(spark, "dwd_user").withColumn("topic", F.lit("dwd_user")), left.select("after"))


def _routed(sent: DataFrame, left: DataFrame) -> DataFrame:
    sent = sent.select("topic", F.from_json("value", "map<string,string>").alias("after")).unionByName(left.select(F.lit("unmatched").alias("topic"), "after"))
    return sent.select("topic", *[F.col("after")[c].alias(c) for c in ("id", "last", "kind")])


def _base_db_stream(spark, sf) -> str:
    """The change job, started three times over a topic that grows; of each start the changes are one batch."""
    where, session = home(spark), stream_session(spark)
    lines, out = Topics(f"{where}/in"), Topics(f"{where}/out")
    for some in _thirds(spark, sf):
        lines.put(sinks.encoded(_changes(spark, sf, some)).withColumn("topic", F.lit("ods_base_db")))
        fanout.start_base_db(session, lines.read(session, "ods_base_db", True), lambda: _config(session), out, f"{where}/dims", f"{where}/ck").awaitTermination()
    return where


@query(_DIM)
def stream_dimension_upsert(spark, sf):
    """The same as a stream of several batches."""
    return sinks.dim_now(spark, f"{_base_db_stream(spark, sf)}/dims", "dim_user")


@query(_ROUTED)
def stream_routed_topics(spark, sf):
    out = Topics(f"{_base_db_stream(spark, sf)}/out")
    left = out.read(spark, "unmatched").select(F.from_json("value", "after map<string,string>").alias("r")).select("r.after")
    return _routed(out.read(spark, "dwd_user").withColumn("topic", F.lit("dwd_user")), left)


_CONFIGURED = """select 't' || c_custkey % 1000 as source_table, c_custkey % 7 as operation, case when c_custkey % 2 = 0 then 'kafka' else 'hbase' end as sink_type, 'dwd_' || c_custkey as sink_table,
    case when c_custkey % 3 > 0 then 'id,name' end as sink_columns, c_custkey % 11 = 0 as gone, c_custkey as ts_ms from customer"""


@query(
    f"""with f as ({_CONFIGURED}), z as (select * from f qualify row_number() over (partition by source_table, operation order by ts_ms desc) = 1)
    select source_table, ['insert', 'c', 'u', 'r', 'x', 'y', 'z'][operation + 1] as operate_type, sink_type, sink_table, sink_columns, 'id' as sink_pk, '' as sink_extend from z where not gone and operation > 0"""
)
def config_rows(spark, sf):
    """The configuration as its feed leaves it, from the first row on: of each key the last row, without
    deleted ones, defaults filled in, columns named in camel case."""
    names = {"sourceTable": "source_table", "operateType": "operate_type", "sinkType": "sink_type", "sinkTable": "sink_table", "sinkColumns": "sink_columns"}
    kinds = F.array(*[F.lit(x) for x in ("insert", "c", "u", "r", "x", "y", "z")])
    table(spark, sf, "customer").createOrReplaceTempView("configured_customers")
    rows = spark.sql(_CONFIGURED.replace("from customer", "from configured_customers")).filter("operation > 0").withColumn("operate_type", kinds[F.col("operation").cast("int")])
    image = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names.values()))
    none = F.lit(None).cast("map<string,string>")
    feed = rows.select(F.when(F.col("gone"), image).otherwise(none).alias("before"), F.when(~F.col("gone"), image).otherwise(none).alias("after"), F.when(F.col("gone"), "d").otherwise("r").alias("op"), F.col("ts_ms").cast("long").alias("ts_ms"))
    out = Topics(home(spark))
    out.put(sinks.encoded(feed).withColumn("topic", F.lit("table_process")))
    return routing.current_config(jobs.config_of(topics.change_rows(out.read(spark, "table_process"), startup="initial"))).drop("ts_ms")


@query("select event_id, event_type as \"eventType\", user_id, case when event_id % 3 = 0 then floor(value)::bigint end as amount from events")
def typed_names(spark, sf):
    """JSON as typed rows, keys in snake, camel or Pascal case; what doesn't fit its type is null."""
    e, n = table(spark, sf, "events"), F.col("event_id") % 3
    pair = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    amount = F.when(n == 0, F.floor("value").cast("string")).when(n == 1, F.lit('"many"')).otherwise("null")
    text = F.concat(F.lit('{"'), pair("event_id", "eventId", "EventId"), F.lit('":'), F.col("event_id").cast("string"), F.lit(',"'), pair("event_type", "eventType", "EVENT_TYPE"), F.lit('":"'), "event_type", F.lit('","'), pair("user_id", "userId", "userid"), F.lit('":'), F.col("user_id").cast("string"), F.lit(',"Amount":'), F.coalesce(amount, F.lit("null")), F.lit("}"))
    return e.select(S.typed_json(text, "event_id bigint, eventType string, user_id bigint, amount bigint").alias("r")).select("r.*")


@query("select user_id::int as id, event_id::bigint as last from events where event_type not in ('error', 'signup')")
def changelog_sql(spark, sf):
    """A change feed as a typed table in SQL."""
    name = f"binlog_{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("last", T.LongType())])
    topics.changelog_view(topics.read_changes(spark, topic(_changes(spark, sf), home(spark))), name, schema)
    return spark.sql(f"select * from {name}")


@query("select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'click' and epoch_us(b.ts) // 1000000 between epoch_us(a.ts) // 1000000 - 3600 and epoch_us(a.ts) // 1000000 + 3600")
def csv_pairs(spark, sf):
    """CSV lines with seconds, joined within an hour."""
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.floor(S.epoch_ms(F.col("ts")) / 1000).cast("string"))
    read = lambda kind, ddl, ts: topics.csv_rows(table(spark, sf, "events").filter(F.col("event_type") == kind).select(line.alias("value")), ddl, ts)
    a, b = read("signup", "id string, a bigint, ats bigint", "ats"), read("click", "rid string, b bigint, bts bigint", "bts")
    return joins.interval_join(a, b, F.col("id") == F.col("rid"), "ats", "bts", "1 hour", "1 hour").select("a", "b")


@query("select event_id, case when event_id % 7 = 0 then event_id else epoch_us(date_trunc('second', ts)) // 1000 - 28800000 end as ms8, case when event_id % 7 = 0 then null else epoch_us(date_trunc('second', ts)) // 1000 end as ms0 from events")
def time_texts(spark, sf):
    """Texts of times in a fixed zone, with a fallback for those that can't be read."""
    text = F.when(F.col("event_id") % 7 == 0, "no time").otherwise(_when("ts"))
    return table(spark, sf, "events").select("event_id", S.parsed_ms(text, F.col("event_id"), "+08:00").alias("ms8"), S.to_ms(text, "+00:00").alias("ms0"))


@query("select event_id, event_type as a, 'set' as b, upper(event_type) as up, '{\"b\":\"' || event_type || '\",\"x\":{\"n\":' || event_id || ',\"v\":[1.5,null]}}' as doc from events")
def json_put(spark, sf):
    """One key of a map of strings, and one of a document whose other fields stay as they are."""
    m = S.put(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("old")), "b", F.lit("set"))
    doc = F.parse_json(F.concat(F.lit('{"x":{"v":[1.50,null],"n":'), F.col("event_id").cast("string"), F.lit('},"b":[0]}')))
    doc = F.to_json(S.put_json(doc, "b", F.col("event_type").cast("variant")))
    return table(spark, sf, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), F.upper("event_type").alias("up"), doc.alias("doc"))


@query("select event_id as \"eventId\", user_id as \"userId\", event_type as \"eventType\" from events")
def camel_names(spark, sf):
    return topics.camel_columns(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


@query("select '{\"event_id\":' || event_id || case when event_type = 'view' then ',\"user_id\":' || user_id else '' end || '}' as value from events")
def json_records(spark, sf):
    """Records without their nulls, to a topic and back."""
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("user_id")).alias("user_id"))
    return topics.read_topic(spark, topic(rows, home(spark)))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(event_id)::bigint as ids from events group by day")
def daily_files(spark, sf):
    """Raw lines in a folder a day."""
    where = home(spark)
    sinks.write_daily(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("value"), "ts"), where, S.date_text(F.col("ts")))
    return spark.read.text(where).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("ids"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(event_id)::bigint as ids from events group by day")
def stream_daily_files(spark, sf):
    """The same as a stream, started three times over a topic that grows."""
    where, session, lines = home(spark), stream_session(spark), Topics(home(spark))
    for some in _thirds(spark, sf):
        rows = table(spark, sf, "events").filter(some)
        lines.put(rows.select(F.lit("applog").alias("topic"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string")).alias("value")))
        sinks.stream_daily(lines.read(session, "applog", True), f"{where}/days", F.substring("value", 1, 10), f"{where}/ck").awaitTermination()
    found = spark.read.text(f"{where}/days").select(F.col("day").cast("string").alias("day"), F.substring_index("value", " ", -1).cast("long").alias("id"))
    return found.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _page_lines(spark, sf, some: str = "true") -> DataFrame:
    """Events as page lines; a sign-up is an entry. ``ts`` has all digits, so that no two rows of a user tie.
    They arrive (``at``) in an order of their own, the greatest id first."""
    kind = F.col("event_type")
    line = F.struct(
        F.struct(F.col("user_id").cast("string").alias("mid"), F.lit("0").alias("is_new"), F.lit("v1").alias("vc"), (F.col("user_id") % 3).cast("string").alias("ch"), kind.alias("ar")).alias("common"),
        F.struct(F.col("event_id").cast("string").alias("page_id"), F.when(kind != "signup", "home").alias("last_page_id"), F.coalesce(F.floor("value"), F.lit(0)).cast("long").alias("during_time")).alias("page"),
        S.epoch_ms(F.col("ts")).alias("ts"),
    )
    return table(spark, sf, "events").filter(some).select(F.to_json(line).alias("value"), F.timestamp_seconds(-F.col("event_id")).alias("at"))


#: A last record, long after all others, moves the streams' time on; nothing is made of it.
_END = '{"common":{"mid":"end","ar":"end"},"page":{"page_id":"0","last_page_id":"x","during_time":0},"ts":4000000000000}'


def _fed_pages(spark, sf, n: int, start) -> None:
    """The page topic in ``n`` appends by time, the last with its end; ``start(session, pages, where)`` runs after each."""
    where, session = home(spark), stream_session(spark)
    pages, parts = Topics(f"{where}/in"), _parts(spark, sf, "events", "ts", n)
    for i, some in enumerate(parts):
        rows = _page_lines(spark, sf, some)
        if i == len(parts) - 1:
            rows = rows.unionByName(spark.createDataFrame([(_END,)], "value string").withColumn("at", F.current_timestamp()))
        pages.put(rows.withColumn("topic", F.lit("dwd_page_log")), at=F.col("at"))
        start(session, pages, where)


def _ids(lines: DataFrame) -> DataFrame:
    path = lambda p: F.get_json_object("value", p)
    return lines.select(path("$.page.page_id").cast("long").alias("event_id"), path("$.common.mid").try_cast("long").alias("user_id"))


_MS = "e as (select *, epoch_us(ts) // 1000 as ms from events)"
_UNIQUE = f"{_MS}, u as (select *, lag(ts::date) over (partition by user_id order by ms, event_id) as before from e where event_type = 'signup')"
_JUMP = f"""n as (select *, lead(ms) over w as nms, lead(event_type = 'signup') over w as nentry from e window w as (partition by user_id order by ms)),
    j as (select * from n where event_type = 'signup' and (nms is null or nms >= ms + 21600000 or nentry))"""


@query(f"with {_UNIQUE} select event_id, user_id from u where before is distinct from ts::date")
def stream_unique_visit(spark, sf):
    """Daily unique visitors by keyed state, over three starts of the stream."""
    out = Topics(home(spark))
    _fed_pages(spark, sf, 3, lambda session, pages, where: streams.start_unique_visit(pages.read(session, "dwd_page_log", True), out, f"{where}/ck", None).awaitTermination())
    return _ids(out.read(spark, "dwm_unique_visit"))


@query(f"with {_MS}, {_JUMP} select event_id, user_id from j")
def stream_user_jump(spark, sf):
    """Bounces by keyed state and timers, over two starts of the stream."""
    out = Topics(home(spark))
    _fed_pages(spark, sf, 2, lambda session, pages, where: streams.start_user_jump(pages.read(session, "dwd_page_log", True), out, f"{where}/ck", 6 * 3_600_000).awaitTermination())
    return _ids(out.read(spark, "dwm_user_jump_detail")).filter("user_id is not null")


@query(
    f"""with {_UNIQUE}, {_JUMP}, r as (select ms, user_id % 3 as k, event_type, 1 as uv, 0 as pv, 0 as sv, 0 as uj, 0 as dur, null as id from u where before is distinct from ts::date
    union all select ms, user_id % 3, event_type, 0, 0, 0, 1, 0, null from j union all select ms, user_id % 3, event_type, 0, 1, (event_type = 'signup')::int, 0, coalesce(floor(value), 0)::bigint, event_id from e)
    select {_TIME.format("make_timestamp((ms // 21600000) * 21600000000)")} as stt, {_TIME.format("make_timestamp((ms // 21600000 + 1) * 21600000000)")} as edt, event_type as ar, k::varchar as ch, '0' as is_new, 'v1' as vc,
    sum(uv)::bigint as uv_ct, sum(pv)::bigint as pv_ct, sum(sv)::bigint as sv_ct, sum(uj)::bigint as uj_ct, sum(dur)::bigint as dur_sum, arg_max(ms, id)::bigint as ts from r group by all"""
)
def stream_visitor_stats(spark, sf):
    """Three topics, the last two written by their own streams, united and summed in event-time windows, all
    three streams started twice. Bounces come hours after their pages, so windows wait for a day."""
    made, stats_out = {n: Topics(home(spark)) for n in ("unique", "jumps")}, Topics(home(spark))

    def start(session, pages, where):
        read = lambda: pages.read(session, "dwd_page_log", True)
        streams.start_unique_visit(read(), made["unique"], f"{where}/ck1", None).awaitTermination()
        streams.start_user_jump(read(), made["jumps"], f"{where}/ck2", 6 * 3_600_000).awaitTermination()
        unique, jumps = made["unique"].read(session, "dwm_unique_visit", True), made["jumps"].read(session, "dwm_user_jump_detail", True)
        streams.start_visitor_stats(read(), unique, jumps, stats_out, f"{where}/ck3", "6 hours", delay="1 day").awaitTermination()

    _fed_pages(spark, sf, 2, start)
    rows = stats_out.read(spark, "dws_visitor_stats").select(F.from_json("value", schemas.VISITOR_STATS).alias("r")).select("r.*")
    return rows.filter("ar <> 'end'")


def _fed_pairs(spark, sf, left, right, start) -> None:
    """Two topics, in two appends each, of what ``left`` and ``right`` give for a condition on ``create_time``;
    ``start(session, left, right, where)`` runs after each."""
    where, session = home(spark), stream_session(spark, stateful=False)
    topics_ = Topics(f"{where}/left"), Topics(f"{where}/right")
    for some in _parts(spark, sf, "orders", "o_orderdate", 2, "create_time"):
        for out, rows in zip(topics_, (left, right)):
            out.put(sinks.encoded(rows(some)).withColumn("topic", F.lit("rows")))
        start(session, *[t.read(session, "rows", True) for t in topics_], where)


@query(f"with {_PAIRS} {_WIDE.format('', '')}")
def stream_order_wide(spark, sf):
    """Order and detail streams, joined, started twice, with the dimensions as they are when a batch comes."""
    out = Topics(home(spark))
    _fed_pairs(spark, sf, partial(_orders, spark, sf), partial(_details, spark, sf), lambda session, orders, details, where: streams.start_order_wide(
        orders, details, lambda: _dims(session, sf), F.lit(AS_OF), out, f"{where}/ck", slack="30 days").awaitTermination())
    return _plain(out.read(spark, "dwm_order_wide").select(F.from_json("value", schemas.ORDER_WIDE).alias("r")).select("r.*"))


@query(_PAID)
def stream_payment_wide(spark, sf):
    """Payment and order streams, joined, started twice."""
    out = Topics(home(spark))
    wides = jobs.order_pairs(sinks.encoded(_orders(spark, sf)), sinks.encoded(_details(spark, sf)), "30 days")
    wides.write.parquet(made := home(spark))  # both appends are cut from it
    _fed_pairs(spark, sf, partial(_payments, spark, sf), spark.read.parquet(made).filter, lambda session, payments, orders, where: streams.start_payment_wide(payments, orders, out, f"{where}/ck").awaitTermination())
    own = "payment_id bigint, payment_create_time string, order_create_time string, subject string, payment_type string, callback_time string, "
    made = out.read(spark, "dwm_payment_wide").select(F.from_json("value", own + schemas.ORDER_WIDE).alias("r")).select("r.*")
    looked_up = [c for spec in joins.order_lookups(F.lit(AS_OF)) for c in spec.columns if c != "sku_name"]
    return _plain(made.drop("create_time", *looked_up))


@query(
    """with k as (select o_orderkey as id, o_orderkey % 7 as chunk, o_orderstatus as status from orders), c as (select l_orderkey as id, l_linenumber as pos, max(l_linestatus) || l_linenumber as status, max(l_returnflag) = 'R' as gone from lineitem group by l_orderkey, l_linenumber),
    z as (select id, pos, status, gone from c qualify row_number() over (partition by id order by pos desc) = 1)
    select k.id, coalesce(z.status, k.status) as status from k left join z on k.id = z.id where not coalesce(z.gone, false)"""
)
def snapshot_feed(spark, sf):
    """Orders read chunk by chunk while line items change and delete them, then the log from each chunk's mark
    on; replayed, the orders as the whole log leaves them."""
    log = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.max("l_linestatus").alias("status"), F.max("l_returnflag").alias("flag"))
    changes = log.select("id", (F.col("id") % 7).alias("chunk"), "pos", F.when(F.col("flag") == "R", "d").otherwise("u").alias("op"), F.concat("status", F.col("pos").cast("string")).alias("image"))
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("chunk"), F.col("o_orderstatus").alias("image"))
    marks = spark.range(7).select(F.col("id").alias("chunk"), (F.col("id") % 3).alias("low"), (F.col("id") % 3 + 2).alias("high"))
    seen = changes.filter("pos <= chunk % 3 + 1").groupBy("id").agg(F.max_by(F.struct("op", "image"), "pos").alias("last"))  # the table when its chunk is read
    found = base.join(seen, "id", "left").filter("not (last.op <=> 'd')").select("id", "chunk", F.coalesce("last.image", "image").alias("image"))
    feed = cdc.snapshot_feed(found, marks, changes, ["id"])
    return cdc.latest(feed, ["id"], ["pos"]).select("id", F.col("image").alias("status"))


_IMAGES = """e as (select user_id, event_id, event_type, case when event_type <> 'error' then event_id end as img from events), p as (select *, lag(img) over w as past, lag(event_type) over w as was from e window w as (partition by user_id order by event_id)),
    b as (select *, case when was <> 'error' then past end as before from p)"""


@query(
    f"""with {_IMAGES} select event_id, false as flag, before as last from b where before is not null
    union all select event_id, true, event_id from b where event_type <> 'error'"""
)
def stream_retract(spark, sf):
    """A log without old images, completed by keyed state over two starts, as a retraction stream. Deletes of what isn't there show nothing."""
    where, session, out = home(spark), stream_session(spark), Topics(home(spark))
    lines = Topics(f"{where}/in")
    low, mid, high = _thirds(spark, sf)
    for some in (low, f"not ({low})"):
        lines.put(sinks.encoded(_changes(spark, sf, some)).withColumn("topic", F.lit("log")))
        changes = cdc.decode_changes(lines.read(session, "log", True)).select(F.coalesce(F.col("after")["id"], F.col("before")["id"]).alias("id"), "op", F.col("ts_ms").alias("ts"), F.lit(None).cast("string").alias("before"), F.to_json("after").alias("after"))
        out.stream(sinks.encoded(stateful.with_before_stream(changes)), f"{where}/ck", "complete").awaitTermination()
    made = out.read(spark, "complete").select(F.from_json("value", "id string, op string, ts bigint, before string, after string").alias("r")).select("r.*")
    return cdc.retract(made).filter("image is not null").select(F.col("ts").alias("event_id"), "flag", F.get_json_object("image", "$.last").cast("long").alias("last"))


@query(f"with {_IMAGES}, z as (select user_id, event_id, event_type from e qualify row_number() over (partition by user_id order by event_id desc) = 1) select event_type as kind, count(*) as n, sum(event_id)::bigint as total from z where event_type <> 'error' group by event_type")
def retracted_sums(spark, sf):
    """Sums by a value that changes: what a key counted for before is taken back."""
    changes = _changes(spark, sf).withColumn("id", F.coalesce(F.col("after")["id"], F.col("before")["id"])).withColumn("before", F.lit(None).cast("map<string,string>"))
    flags = cdc.retract(cdc.with_before(changes, ["id"], ["ts_ms"])).filter("image is not null")
    return cdc.retracted_sums(flags, [F.col("image")["kind"].alias("kind")], F.col("image")["last"].cast("long"))


@query(f"with {_MS}, {_JUMP} select event_id, user_id, case when nms < ms + 21600000 then 'match' else 'timeout' end as kind from j")
def stream_jump_kinds(spark, sf):
    """Bounces, those that another entry follows and those that nothing does, in topics of their own."""
    out = Topics(home(spark))
    _fed_pages(spark, sf, 2, lambda session, pages, where: streams.start_user_jump(pages.read(session, "dwd_page_log", True), out, f"{where}/ck", 6 * 3_600_000, topic="match", timed_out="timeout").awaitTermination())
    kinds = [_ids(out.read(spark, k)).withColumn("kind", F.lit(k)) for k in ("match", "timeout")]
    return kinds[0].unionByName(kinds[1]).filter("user_id is not null")


@query(
    """with m as (select max(event_id) // 3 as third from events) select case when event_type = 'purchase' then 'dwd_order' when event_id < third then 'dwd_user' else 'dwd_user_new' end as topic, user_id::varchar as id, event_id::varchar as last, event_type as kind
    from events, m where event_type in ('signup', 'purchase')"""
)
def stream_config_change(spark, sf):
    """A configuration that changes between batches: sign-ups go to a new topic from the second batch on, and
    purchases, which nothing names at first, are held and sent when their row arrives with the third."""
    where, session, out = home(spark), stream_session(spark), Topics(home(spark))
    lines = Topics(f"{where}/in")
    rows = [("user_info", "r", "kafka", "dwd_user", 1), ("user_info", "r", "kafka", "dwd_user_new", 2), ("order_info", "insert", "kafka", "dwd_order", 3), *[("user_info", op, "none", "", 1) for op in "cu"]]
    config = session.createDataFrame([(*r[:4], None, None, None, r[4]) for r in rows], f"{schemas.TABLE_PROCESS}, ts_ms bigint")
    for batch, some in enumerate(_thirds(spark, sf), 1):
        lines.put(sinks.encoded(_changes(spark, sf, some)).withColumn("topic", F.lit("ods_base_db")))
        now = config.filter(F.col("ts_ms") <= batch)
        fanout.start_base_db(session, lines.read(session, "ods_base_db", True), lambda now=now: now, out, f"{where}/dims", f"{where}/ck", held=f"{where}/held").awaitTermination()
    sent = _read_all(spark, out, ("dwd_user", "dwd_user_new", "dwd_order")).select("topic", F.from_json("value", "map<string,string>").alias("after"))
    return sent.select("topic", *[F.col("after")[c].alias(c) for c in ("id", "last", "kind")])


@query(
    """with m as (select max(event_id) // 3 as third from events), v as (select 0 as version, third as upto from m union all select 1, third * 2 from m union all select 2, third * 4 + 9 from m)
    select version, user_id::varchar as id, max(event_id)::varchar as last from events, v where event_type in ('click', 'view') and event_id < upto and user_id % 5 = 0 group by version, user_id"""
)
def dimension_versions(spark, sf):
    """A dimension as each of three batches left it, read for some keys: only their buckets are."""
    where, keys = home(spark), table(spark, sf, "events").filter("user_id % 5 = 0").select("user_id").distinct()
    for batch, some in enumerate(_thirds(spark, sf)):
        jobs.base_db(spark, sinks.encoded(_changes(spark, sf, some)), _config(spark), Topics(f"{where}/topics"), f"{where}/dims", batch=batch)
    parts = [sinks.dim_now(spark, f"{where}/dims", "dim_user", keys, version).filter("id % 5 = 0").select(F.lit(version).alias("version"), "id", "last") for version in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """with e as (select *, epoch_us(ts) // 1000 as ms from events), m as (select make_timestamp((epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) // 1000000 * 1000000) as cut from events),
    f as (select e.*, ts < cut and event_id % 10 > 0 as early, (ms // 21600000 + 1) * 21600000 as ends from e, m), w as (select max(ms) - 43200000 as mark from f where early)
    select strftime(make_timestamp((ends - 21600000) * 1000), '%Y-%m-%d %H:%M:%S') as stt, event_type, count(*) as pv_ct, sum(event_id)::bigint as dur_sum from f, w where early or ends > mark group by stt, event_type"""
)
def stream_late_rows(spark, sf):
    """A tenth of the first half's rows come with the second half: those whose window has been closed by then
    are lost, all others still count."""
    where, session, lines, out = home(spark), stream_session(spark), Topics(home(spark)), Topics(home(spark))
    first, _ = _parts(spark, sf, "events", "ts", 2)
    early = f"{first} and event_id % 10 > 0"
    for some in (early, f"not ({early})", None):
        rows = table(spark, sf, "events").filter(some or "false").select(F.lit("pages").alias("topic"), F.to_json(F.struct(S.epoch_ms(F.col("ts")).alias("ms"), "event_type", "event_id")).alias("value"))
        end = spark.createDataFrame([("pages", '{"ms":4000000000000,"event_type":"end","event_id":0}')], "topic string, value string")
        lines.put(rows if some else end)
        read = lines.read(session, "pages", True).select(F.from_json("value", "ms bigint, event_type string, event_id bigint").alias("r")).select(F.timestamp_millis("r.ms").alias("time"), "r.*")
        page = stats.page_rows(read, ["time", "event_type"], F.lit("home"), F.col("event_id"))
        out.stream(sinks.encoded(sj.windowed_stream([page], "time", "6 hours", ("event_type",), delay="12 hours")), f"{where}/ck", "sums").awaitTermination()
    made = out.read(spark, "sums").select(F.from_json("value", "stt string, event_type string, pv_ct bigint, dur_sum bigint").alias("r")).select("r.*")
    return made.filter("event_type <> 'end'")


@query("with m as (select max(event_id) // 3 as third from events) select event_id, case when event_id >= third * 2 then 'rest' when event_id >= third then 'begun' else 'first' end as read from events, m")
def topic_group(spark, sf):
    """A topic read by a group that commits what it has read: each read begins after the last commit."""
    out, found = Topics(home(spark), partitions=4), []
    for n, (some, name) in enumerate(zip(_thirds(spark, sf), ("first", "begun", "rest"))):
        rows = table(spark, sf, "events").filter(some)
        out.put(rows.select(F.lit("events").alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value")))
        read = out.read(spark, "events", group="readers")
        found.append(read.select(F.col("value").cast("long").alias("event_id"), F.lit(name).alias("read")))
        out.commit(read, "events", "readers", n)
    return found[0].unionByName(found[1]).unionByName(found[2])


_MET = _PAIRS.replace("d.id as detail_id", "d.id as detail_id, greatest(o.at, d.at) as met")
_CUT = "date_trunc('second', min(o_orderdate)::timestamp + (max(o_orderdate)::timestamp - min(o_orderdate)::timestamp) / 2)"


@query(f"with m as (select {_CUT} as cut from orders), {_MET} " + _WIDE.format("", "").replace("p.*, c_mktsegment as user_gender", "p.* exclude (met), case when c_custkey % 2 = 0 and met >= (select cut from m) then 'changed' else c_mktsegment end as user_gender"))
def stream_order_wide_dims(spark, sf):
    """Orders enriched from dimension tables that change between two batches; a batch reads the buckets that its
    keys fall into."""
    where, out, starts = home(spark), Topics(home(spark)), []
    dims = _dims(spark, sf)

    def routed(name: str, rows: DataFrame, at: int) -> DataFrame:
        image = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*rows.columns))
        return rows.select(F.lit(name).alias("sink_table"), F.lit("ID").alias("sink_pk"), image.alias("after"), F.lit(at).cast("long").alias("ts_ms"))

    def start(session, orders, details, folder):
        users = dims["DIM_USER_INFO"].filter("int(ID) % 2 = 0").withColumn("GENDER", F.lit("changed"))
        parts = [routed("DIM_USER_INFO", users, 1)] if starts else [routed(n, rows, 0) for n, rows in dims.items()]
        for part in parts[1:]:
            parts[0] = parts[0].unionByName(part)
        sinks.put_dims(parts[0], f"{where}/dims", len(starts))
        starts.append(1)

        def read_dims():
            read = DimStore(f"{where}/dims").reader(session)
            return lambda name, keys: read(name, dims[name].columns, keys)

        streams.start_order_wide(orders, details, read_dims, F.lit(AS_OF), out, f"{folder}/ck", slack="30 days").awaitTermination()

    _fed_pairs(spark, sf, partial(_orders, spark, sf), partial(_details, spark, sf), start)
    return _plain(out.read(spark, "dwm_order_wide").select(F.from_json("value", schemas.ORDER_WIDE).alias("r")).select("r.*"))
