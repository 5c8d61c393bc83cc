"""The fan-out jobs over a few files."""

import json

import pytest

from streamloom.sources.topics import read_topic
from streamloom.streaming import joins as sj
from streamloom.records import Topics
from streamloom.sinks import dim_now
from streamloom.streaming.fanout import start_base_db, start_base_log
from tests.test_warehouse import LOG, change


@pytest.fixture(autouse=True)
def settings(spark):
    sj.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def records(spark, out, topic):
    return [json.loads(r.value) for r in Topics(str(out)).read(spark, topic).collect()]


def log_stream(spark, tmp_path):
    query = start_base_log(read_topic(spark, str(tmp_path / "in"), True), Topics(str(tmp_path / "out")), str(tmp_path / "ck"))
    assert query.awaitTermination(180)


def test_base_log_stream(spark, tmp_path):
    """State lasts from one start to the next; what no job knows goes through."""
    put(tmp_path / "in", "1", json.dumps(LOG | {"extra": {"x": [1.5]}}), json.dumps(LOG | {"start": "icon", "ts": LOG["ts"] + 9}), "{bad")
    log_stream(spark, tmp_path)
    put(tmp_path / "in", "2", json.dumps(LOG | {"ts": LOG["ts"] + 20}))
    log_stream(spark, tmp_path)
    pages = {p["ts"] - LOG["ts"]: p for p in records(spark, tmp_path / "out", "page")}
    assert {k: p["common"]["is_new"] for k, p in pages.items()} == {0: "1", 20: "0"} and pages[0]["extra"] == {"x": [1.5]}
    assert len(records(spark, tmp_path / "out", "display")) == 4 and len(records(spark, tmp_path / "out", "start")) == 1


def test_base_log_stream_loses_and_doubles_nothing(spark, tmp_path):
    """Dirty lines are written, lines without device or time go to their topics, equal lines stay two."""
    common = LOG["common"]
    given = [LOG, LOG, LOG | {"ts": None}, LOG | {"common": common | {"mid": None}}, {"start": "icon", "common": common, "ts": None}, {"ts": 1}]
    put(tmp_path / "in", "1", *map(json.dumps, given), "{bad", "7", "{bad")
    log_stream(spark, tmp_path)
    pages = records(spark, tmp_path / "out", "page")
    assert sorted((p["ts"] or 0, p["common"].get("mid") or "", p["common"]["is_new"]) for p in pages) == sorted([(LOG["ts"], common["mid"], "1"), (LOG["ts"], common["mid"], "0"), (0, common["mid"], "1"), (LOG["ts"], "", "1")])
    assert len(records(spark, tmp_path / "out", "start")) == 1 and len(records(spark, tmp_path / "out", "display")) == 4 * len(LOG["displays"])
    assert sorted(r.value for r in Topics(str(tmp_path / "out")).read(spark, "dirty").collect()) == sorted(['{"ts": 1}', "7", "{bad", "{bad"])


def test_base_db_stream(spark, tmp_path):
    """Dimensions are upserted, what has no configuration is held and sent when its row comes."""
    ddl = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
    rows = [("order_info", "c", "kafka", "dwd_order_info", "id", None, None)] + [("base_trademark", op, "hbase", "dim_base_trademark", "id,tm_name", None, None) for op in "cu"]
    config = [rows]
    put(tmp_path / "in", "1", change("c", None, {"id": "1", "tm_name": "a"}), change("c", None, {"id": "9", "x": "y"}, "order_info"), change("c", None, {"id": "5"}, "late"))
    dims, out, read = str(tmp_path / "dims"), Topics(str(tmp_path / "out")), lambda: spark.createDataFrame(config[-1], ddl)
    for n in (2, 3, 1):  # each start brings one file
        assert start_base_db(spark, read_topic(spark, str(tmp_path / "in"), True), read, out, dims, str(tmp_path / "ck"), str(tmp_path / "held")).awaitTermination(180)
        put(tmp_path / "in", str(n), change("u", {"id": "1"}, {"id": "1", "tm_name": f"b{n}"}, ts=n), change("c", None, {"id": f"2{n}", "tm_name": "c"}, ts=6))
        if n == 3:
            config.append([*rows, ("late", "c", "kafka", "dwd_late", None, None, None)])
    assert sorted(map(tuple, dim_now(spark, dims, "dim_base_trademark").collect())) == [("1", "b3"), ("22", "c"), ("23", "c")]
    assert sorted(map(tuple, dim_now(spark, dims, "dim_base_trademark", version=1).collect())) == [("1", "b2"), ("22", "c")]
    assert records(spark, tmp_path / "out", "dwd_order_info") == [{"id": "9"}] and records(spark, tmp_path / "out", "dwd_late") == [{"id": "5"}]
