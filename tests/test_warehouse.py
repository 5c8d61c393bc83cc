"""Exact semantics on small fixtures."""

import json
import random
import socket
import threading
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from streamloom.functions import scalars as S
from streamloom.operators import cdc, joins, logs, routing, stats, visits
from streamloom.plans import jobs
from streamloom.records import Topics
from streamloom.sinks import console, create_dim_tables, dim_now, encoded, routed_records, upsert, write_daily, write_topic
from streamloom.sources import topics

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize(("exclusive", "kept"), [(False, [95, 100, 105]), (True, [100])])
def test_interval_pairs(spark, exclusive, kept):
    left = topics.csv_rows(lines(spark, "1001,a,100"), "id string, name string, ts bigint", "ts")
    right = topics.csv_rows(lines(spark, *[f"1001,m,{t}" for t in (94, 95, 100, 105, 106)], "1002,m,100"), "rid string, sex string, rts bigint", "rts")
    out = joins.interval_join(left, right, F.col("id") == F.col("rid"), "ts", "rts", "5 seconds", "5 seconds", exclusive, exclusive)
    assert sorted(r.rts.timestamp() for r in out.collect()) == kept


LOG = {"common": {"mid": "m1", "is_new": "1", "vc": "v2", "ch": "web", "ar": "11"}, "page": {"page_id": "home", "during_time": 1200}, "displays": [{"item": "7"}, {"item": "9"}], "ts": 1704067200000}


def test_log_records(spark):
    """Whole documents: fields that no job knows, at every level, numbers and nulls go through; one flag changes."""
    odd = LOG | {"common": LOG["common"] | {"os": {"v": [1, 2.5, None]}, "uid": 12345678901234567890}, "extra": {"b": True, "a": None}, "page": LOG["page"] | {"item": {"x": 1}}, "displays": [{"item": "7", "pos": 1, "in": {"z": [1]}}, {"item": "9"}]}
    start = LOG | {"start": {"ms": 12, "entry": "icon"}, "ts": LOG["ts"] + 1}
    bad = ["{bad", "", "null", "[1]", None, json.dumps({"ts": 1}), json.dumps({"common": {"mid": "x"}, "ts": 1}), json.dumps(LOG | {"displays": [7]}), json.dumps(LOG | {"displays": {"item": "7"}}), json.dumps(LOG | {"common": "x"}), '{"common":{},"common":{},"start":"x"}']
    keyless = [LOG | {"common": {"is_new": "1"}, "displays": None}, LOG | {"ts": None, "displays": []}, LOG | {"start": "", "common": {"mid": "m2"}, "displays": []}]
    parts = jobs.base_log(lines(spark, json.dumps(odd), json.dumps(start), *bad, *map(json.dumps, keyless)))
    read = lambda name: [json.loads(r.value) for r in parts[name].collect()]
    by = lambda docs: sorted(docs, key=lambda d: json.dumps(d, sort_keys=True))
    assert by(read("page")) == by([odd, *keyless])
    assert read("start") == [start | {"common": start["common"] | {"is_new": "0"}}]  # its device was seen a millisecond before
    assert by(read("display")) == by([{"item": "7", "pos": 1, "in": {"z": [1]}, "page_id": "home"}, {"item": "9", "page_id": "home"}])
    assert sorted((r.value for r in parts["dirty"].collect()), key=str) == sorted(bad, key=str)


@pytest.mark.parametrize(("flags", "fixed", "known"), [("111", "100", "100"), ("011", "010", "000")])
def test_new_visitor(spark, flags, fixed, known):
    rows = spark.createDataFrame([("m", f, i) for i, f in enumerate(flags)], "mid string, is_new string, ts int")
    for option, want in ((False, fixed), (True, known)):
        assert "".join(r.is_new for r in logs.repair_new_visitor(rows, known_counts=option).orderBy("ts").collect()) == want


@pytest.mark.parametrize(("days", "kept"), [("112", [0, 2]), ("212", [0, 1, 2])])
def test_unique_visits(spark, days, kept):
    rows = spark.createDataFrame([("m", d, i, True) for i, d in enumerate(days)] + [("m", "9", 5, False)], "mid string, day string, ts int, entry boolean")
    assert sorted(r.ts for r in visits.unique_visits(rows, F.col("entry"), F.col("day"), "mid", ("ts",)).collect()) == kept


def automaton(events, within=10):
    """Entries not followed by a page in time; events in order of (seconds, entry)."""
    out, waiting = [], None
    for ts, entry in events:
        if waiting is not None and (ts - waiting >= within or entry):
            out.append(waiting)
        waiting = ts if entry else None
    return out + ([waiting] if waiting is not None else [])


@pytest.mark.parametrize(("events", "kept"), [([(0, 1)], [0]), ([(0, 1), (3, 0)], []), ([(0, 1), (3, 1)], [0, 3]), ([(0, 1), (10, 0)], [0]), ([(0, 1), (11, 0)], [0]), ([(0, 1), (3, 1), (5, 0)], [0])])
def test_bounces(spark, events, kept):
    assert automaton(events) == kept
    rows = spark.createDataFrame([("m", at(t), bool(e)) for t, e in events], "mid string, ts timestamp, entry boolean")
    out = visits.bounces(rows, F.col("entry"), "ts", "mid", (), "10 seconds")
    assert sorted((r.ts - T0).seconds for r in out.collect()) == kept


def test_bounces_random(spark):
    rng = random.Random(5)
    events = {m: sorted((t, rng.random() < 0.5) for t in rng.sample(range(200), 30)) for m in range(10)}
    rows = spark.createDataFrame([(m, at(t), e) for m, x in events.items() for t, e in x], "mid int, ts timestamp, entry boolean")
    out = visits.bounces(rows, F.col("entry"), "ts", "mid", (), "10 seconds").collect()
    for m, x in events.items():
        assert sorted((r.ts - T0).seconds for r in out if r.mid == m) == automaton(x)


def change(op, before=None, after=None, table="base_trademark", ts=1):
    return json.dumps({"before": before, "after": after, "source": {"db": "g", "table": table, "ts_ms": ts}, "op": op, "ts_ms": ts})


def test_changes(spark):
    rows = cdc.decode_changes(lines(spark, change("c", None, {"id": "1"}), change("u", {"id": "1"}, {"id": "2"}), change("d", {"id": "2"}), change(None, None, {"id": "3"})))
    assert cdc.without_deletes(rows).count() == 3
    flags = cdc.retract(rows.filter("op is not null")).select("flag", "image.id").collect()
    assert sorted(map(tuple, flags)) == [(False, "1"), (False, "2"), (True, "1"), (True, "2")]
    plain = {r.type: r for r in cdc.plain_envelope(rows.filter("op is not null")).collect()}
    assert set(plain) == {"insert", "update", "delete"} and plain["delete"].after == {} and plain["insert"].tableName == "base_trademark"
    with pytest.raises(Exception):  # noqa: B017
        cdc.decode_changes(lines(spark, "{bad")).collect()


def test_routing(spark, tmp_path):
    config = spark.createDataFrame(
        [("order_info", "insert", "kafka", "dwd_order_info", "id,user_id", None, None), ("base_trademark", "c", "hbase", "dim_base_trademark", "id, tm_name", None, None), ("t", "c", "clickhouse", "x", "id", None, None)],
        "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string",
    )
    left = jobs.base_db(spark, lines(spark, change("c", None, {"id": "1", "user_id": "2", "x": "3"}, "order_info"), change("c", None, {"id": "1", "tm_name": "a"}), change("c", None, {"id": "1"}, "t"), change("c", None, {"id": "1"}, "nobody"), change("d", {"id": "1"}, None, "order_info")), config, Topics(str(tmp_path / "topics")), str(tmp_path / "dims"))
    assert [r.table for r in left.collect()] == ["nobody"]
    sent = Topics(str(tmp_path / "topics")).read(spark, "dwd_order_info").collect()
    assert [json.loads(r.value) for r in sent] == [{"id": "1", "user_id": "2"}]
    assert dim_now(spark, str(tmp_path / "dims"), "dim_base_trademark").collect() == [("1", None)]  # the row is put; names aren't trimmed
    assert dim_now(spark, str(tmp_path / "dims"), "dim_base_trademark").columns == ["id", " tm_name"]
    facts = cdc.decode_changes(lines(spark, change("c", None, {"id": "1", "tm_name": "a"}))).withColumn("table", F.col("source.table"))
    assert routing.route(facts, routing.current_config(config))["hbase"].first().after == {"id": "1"}  # names aren't trimmed
    assert create_dim_tables(spark, config, str(tmp_path / "dims")) == []
    bare = spark.createDataFrame([("a", "c", "hbase", "dim_a", None, None, "compression=gzip"), ("a", "c", "hbase", "dim_old", "id", "k", None)], config.schema).withColumn("ts_ms", F.when(F.col("sink_table") == "dim_a", 2).otherwise(1))
    now = routing.current_config(bare)
    assert [(r.sink_table, r.sink_pk, r.sink_extend) for r in now.collect()] == [("dim_a", "id", "compression=gzip")]  # the last one written, by time
    assert create_dim_tables(spark, now, str(tmp_path / "dims")) == ["dim_a"] and dim_now(spark, str(tmp_path / "dims"), "dim_a").columns == ["id"]
    assert routing.dim_schema(None, "k") == "`k` string not null" and routing.extend_options(" a=1, b=2 x") == {"a": "1", "b": "2"}


def test_dimension_upserts(spark):
    now = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    changes = spark.createDataFrame([("2", "c", 5), ("2", "d", 9), ("3", None, 1)], "id string, name string, at bigint")
    assert sorted(map(tuple, upsert(now, changes, ["id"], "at").collect()), key=str) == [("1", "a"), ("2", "d"), ("3", None)]


ORDER = {"id": 1, "province_id": 1, "order_status": "1001", "user_id": 7, "total_amount": 100, "create_time": "2024-01-01 10:00:00"}
DETAIL = {"id": 11, "order_id": 1, "sku_id": 5, "order_price": 100, "sku_num": 1, "sku_name": "old", "create_time": "2024-01-01 10:00:05"}


def _dims(spark):
    make = lambda row: spark.createDataFrame([tuple(row.values())], list(row))
    return {
        "DIM_USER_INFO": make({"ID": "7", "GENDER": "F", "BIRTHDAY": "2000-01-01"}),
        "DIM_BASE_PROVINCE": make({"ID": "1", "NAME": "p", "AREA_CODE": "1", "ISO_CODE": "CN-1", "ISO_3166_2": "CN-A"}),
        "DIM_SKU_INFO": make({"ID": "5", "SKU_NAME": "new", "CATEGORY3_ID": "3", "SPU_ID": "4", "TM_ID": "6"}),
        "DIM_SPU_INFO": make({"ID": "4", "SPU_NAME": "spu"}),
        "DIM_BASE_TRADEMARK": make({"ID": "6", "TM_NAME": "tm"}),
        "DIM_BASE_CATEGORY3": make({"ID": "99", "NAME": "other"}),
    }


def test_order_and_payment_wide(spark):
    late = DETAIL | {"id": 12, "create_time": "2024-01-01 10:00:06"}
    read = lambda *rows: lines(spark, *map(json.dumps, rows))
    as_of = F.lit("2024-01-01")
    assert jobs.order_wide(read(ORDER), read(DETAIL, late), _dims(spark), as_of).count() == 0  # no such category
    wide = jobs.order_wide(read(ORDER), read(DETAIL, late), _dims(spark), as_of, "left").collect()
    assert [(r.detail_id, r.sku_name, r.tm_name, r.user_age, r.create_hour, r.create_date, r.category3_name, r.split_feight_fee) for r in wide] == [(11, "new", "tm", 24, "10", "2024-01-01", None, None)]
    wides = spark.createDataFrame([(1, 7, Decimal(100), f"2024-01-01 {t}") for t in ("09:45:00", "09:44:59", "10:00:05", "10:00:06")], "order_id bigint, user_id bigint, total_amount decimal(16,2), create_time string")
    paid = jobs.payment_wide(read({"id": 3, "order_id": 1, "user_id": 7, "total_amount": 90, "create_time": "2024-01-01 10:00:00"}), wides).collect()
    assert sorted(r.order_create_time[11:] for r in paid) == ["09:45:00", "10:00:05"] and {r.total_amount for r in paid} == {Decimal("90.00")}


def test_merge_and_statistics(spark):
    a = spark.createDataFrame([(1, None, "x")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "y", "z"), (2, "q", None)], "id int, a string, b string")
    assert sorted(map(tuple, joins.merged_orders(a, b, ["id"]).collect())) == [(1, "y", "x"), (2, "q", None)]
    pages = jobs.pages_of(lines(spark, json.dumps(LOG), json.dumps(LOG | {"ts": LOG["ts"] + 9999, "page": {"page_id": "b", "last_page_id": "home"}}), json.dumps(LOG | {"ts": LOG["ts"] + 10000})))
    out = jobs.visitor_stats(pages, jobs.unique_visit(pages), jobs.user_jump(pages)).orderBy("stt").collect()
    assert [(r.stt[11:], r.edt[11:], r.uv_ct, r.pv_ct, r.sv_ct, r.uj_ct, r.dur_sum) for r in out] == [("00:00:00", "00:00:10", 1, 2, 1, 0, 1200), ("00:00:10", "00:00:20", 0, 1, 1, 1, 1200)]
    assert stats.COUNTS[0] == "uv_ct"


def test_scalars(spark):
    r = spark.range(1).select(
        S.to_ms(F.lit("2024-01-01 08:00:00")).alias("ms"), S.parsed_ms(F.lit("?"), F.lit(5)).alias("fallback"), S.hour_part(F.lit("2024-01-01 07:30:00")).alias("hour"), S.date_part(F.lit("2024-01-01 07:30:00")).alias("day"),
        S.is_empty(F.lit("")).alias("empty"), S.put(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2")).alias("put"), S.age_years(F.lit("2000-01-01"), F.lit("2024-01-01")).alias("age"), F.struct(*S.topic_parts(F.lit("s.db.t"))).alias("topic"),
    ).first()
    assert (r.ms, r.fallback, r.hour, r.day, r.empty, r.put, r.age, tuple(r.topic)) == (1704067200000, 5, "07", "2024-01-01", True, {"a": "2"}, 24, ("db", "t"))
    assert S.camel("USER_NAME_X") == "userNameX"


def test_topics_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(r.value for r in encoded(rows).collect()) == ['{"a":1}', '{"a":2,"b":"x"}']
    write_topic(rows, str(tmp_path / "t"))
    assert topics.read_topic(spark, str(tmp_path / "t")).count() == 2
    write_daily(lines(spark, "l1"), str(tmp_path / "d"), F.lit("2024-01-01"))
    assert spark.read.text(str(tmp_path / "d")).first().value == "l1"
    routed = spark.createDataFrame([("t1", {"a": "1", "b": None})], "sink_table string, after map<string,string>")
    assert routed_records(routed).collect() == [("t1", '{"a":"1"}')]
    write_topic(lines(spark, "x"), str(tmp_path / "c"))
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/1.json").write_text("\n".join([change("r", None, {"id": "1"}), change("c", None, {"id": "2"}), change("c", None, {"id": "3"}, "other")]))
    assert topics.read_changes(spark, str(tmp_path / "feed"), tables=["g.base_trademark"]).count() == 1
    assert topics.read_changes(spark, str(tmp_path / "feed"), startup="initial").count() == 3
    from pyspark.sql import types as T

    topics.changelog_view(topics.read_changes(spark, str(tmp_path / "feed")), "binlog", T.StructType([T.StructField("id", T.IntegerType())]))
    assert sorted(r.id for r in spark.sql("select * from binlog").collect()) == [2, 3]
    config = jobs.config_of(cdc.decode_changes(lines(spark, change("c", None, {"source_table": "a", "operate_type": "c", "sink_type": "kafka"}), change("d", {"source_table": "a", "operate_type": "c"}, None, "t", 2), change("r", None, {"source_table": "b", "operate_type": "c"}))).withColumn("ts_ms", F.col("ts_ms")))
    assert [r.source_table for r in config.collect()] == ["b"]


def test_jdbc_query(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/store;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(1, "north", None), (2, "south", 7)], "id int, region_name string, tm_count int")
    rows.write.format("jdbc").options(url=url, driver=driver, dbtable="base_province").save()
    query = 'select "region_name", "tm_count" from base_province where "id" > 1'
    assert topics.read_jdbc(spark, url, query, driver=driver).columns == ["region_name", "tm_count"]
    found = topics.read_jdbc(spark, url, query, to_camel=True, driver=driver)
    assert found.columns == ["regionName", "tmCount"] and [tuple(r) for r in found.collect()] == [("south", 7)]
    assert topics.read_jdbc(spark, url, 'select "id" from base_province where "id" > 9', driver=driver).count() == 0
    spark.range(100).selectExpr("if(id = 7, null, id * id) as id", "id as n").write.format("jdbc").options(url=url, driver=driver, dbtable="squares").save()
    for parts in (1, 4, 9):
        dealt = topics.read_jdbc(spark, url, 'select * from squares', key='"id"', parts=parts, driver=driver)
        assert dealt.rdd.getNumPartitions() == parts and sorted(r.n for r in dealt.collect()) == list(range(100))
    assert topics.read_jdbc(spark, url, 'select * from squares where "id" < 0', key='"id"', driver=driver).count() == 0


def test_socket_and_console(spark):
    """Lines of a socket as a stream, split as CSV, and shown at the console."""
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        while True:  # the source opens a connection for its schema's sake and one for each run
            try:
                peer, _ = server.accept()
                peer.sendall(b"1,first,1700000000\n2,second,1700000060\n")
                open_.append(peer)
            except OSError:
                return

    open_ = []
    threading.Thread(target=serve, daemon=True).start()
    rows = topics.csv_rows(topics.read_socket(spark, "127.0.0.1", port), "id int, name string, ts bigint", seconds="ts")
    query = console(rows)
    memory = rows.writeStream.format("memory").queryName("socket_rows").start()
    try:
        end = time.time() + 60
        while spark.table("socket_rows").count() < 2 and time.time() < end:
            time.sleep(0.2)
        got = [(r.id, r.name, r.ts.timestamp()) for r in spark.table("socket_rows").orderBy("id").collect()]
        query.processAllAvailable()
    finally:
        query.stop()
        memory.stop()
        server.close()
        for peer in open_:
            peer.close()
    assert got == [(1, "first", 1_700_000_000), (2, "second", 1_700_000_060)]
    assert query.exception() is None


def test_snapshot_feed_and_retraction(spark):
    """Whatever a chunk's read saw of the changes between its marks, the feed leaves the table as the log does."""
    rng = random.Random(7)
    log = [(k, k % 2, pos, rng.choice("ccud"), f"v{pos}") for pos, k in enumerate(rng.choices(range(12), k=60), 1)]
    marks = {0: (10, 30), 1: (25, 40)}
    for seen in ({0: 10, 1: 25}, {0: 20, 1: 33}, {0: 30, 1: 40}):
        now = {}
        for k, c, pos, op, image in log:
            if pos <= seen[c]:
                now[k] = None if op == "d" else image
        snapshot = [(k, k % 2, v) for k, v in now.items() if v is not None]
        feed = cdc.snapshot_feed(spark.createDataFrame(snapshot, "id int, chunk int, image string"), spark.createDataFrame([(c, *m) for c, m in marks.items()], "chunk int, low int, high int"), spark.createDataFrame(log, "id int, chunk int, pos int, op string, image string"), ["id"])
        want = {k: (op, image) for k, c, pos, op, image in log}
        assert {r.id: r.image for r in cdc.latest(feed, ["id"], ["pos"]).collect()} == {k: v for k, (op, v) in want.items() if op != "d"}
    rows = spark.createDataFrame([("1", "c", 1, "a"), ("1", "c", 2, "b"), ("1", "d", 3, None), ("1", "c", 4, "c"), ("2", "u", 5, "x")], "id string, op string, ts int, after string").withColumn("before", F.lit(None).cast("string"))
    full = cdc.with_before(rows, ["id"], ["ts"])
    assert [(r.op, r.before) for r in full.orderBy("ts").collect()] == [("c", None), ("u", "a"), ("d", "b"), ("c", None), ("u", None)]
    sums = cdc.retracted_sums(cdc.retract(full).filter("image is not null"), [F.lit(1).alias("g")], F.length("image"))
    assert [(r.n, r.total) for r in sums.collect()] == [(2, 2)]  # what is left is c of key 1 and x of key 2


def test_typed_json_and_views(spark):
    given = ['{"user_id":1,"userName":"a","Total-Amount":2.50}', '{"userId":"x","user_name":null}', '{"USERID":3,"user_name":"n","userName":"m"}', "[1]", "{bad", None, "{}"]
    rows = lines(spark, *given).select(S.typed_json(F.col("value"), "user_id bigint, user_name string, totalAmount decimal(16,2)").alias("r")).collect()
    assert [r.r and tuple(r.r) for r in rows] == [(1, "a", Decimal("2.50")), (None, None, None), (3, "n", None), None, None, None, (None, None, None)]
    from pyspark.sql import types as T

    log = cdc.decode_changes(lines(spark, change("c", None, {"id": "1", "n": "a"}, ts=1), change("u", {"id": "1"}, {"id": "1", "n": "b"}, ts=2), change("c", None, {"id": "2", "n": "c"}, ts=3), change("d", {"id": "2"}, None, ts=4)))
    kinds = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.StringType())])
    topics.changelog_view(log, "every_image", kinds)
    topics.changelog_view(log, "current_rows", kinds, ["id"])
    assert sorted(map(tuple, spark.sql("select * from every_image").collect())) == [(1, "a"), (1, "b"), (2, "c")]
    assert list(map(tuple, spark.sql("select * from current_rows").collect())) == [(1, "b")]
