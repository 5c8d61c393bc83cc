"""Streams give what the batch forms give, over fixed micro-batches."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from streamloom.records import Topics
from streamloom.streaming import jobs as streams
from streamloom.streaming import joins as sj
from streamloom.streaming import stateful
from tests.test_warehouse import automaton


@pytest.fixture(autouse=True)
def stream_settings(spark):
    sj.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def feed(spark, tmp_path, batches, ddl, name="in"):
    """A stream of one file for each micro-batch."""
    import os

    (tmp_path / name).mkdir()
    for i, rows in enumerate(batches):
        path = tmp_path / name / f"{i:03}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))


def drained(out, tmp_path, mode="append"):
    name = f"out{abs(hash(str(tmp_path)))}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)  # the stream ends with its input
    return out.sparkSession.table(name).collect()


def test_new_visitor_stream(spark, tmp_path):
    rows = [[{"mid": "m", "is_new": "1", "ts": 2, "payload": "b"}, {"mid": "m", "is_new": "1", "ts": 1, "payload": "a"}], [{"mid": "m", "is_new": "1", "ts": 3, "payload": "c"}, {"mid": "n", "is_new": "0", "ts": 3, "payload": "d"}]]
    out = stateful.repaired_stream(feed(spark, tmp_path, rows, "mid string, is_new string, ts bigint, payload string"))
    assert {r.payload: r.is_new for r in drained(out, tmp_path)} == {"a": "1", "b": "0", "c": "0", "d": "0"}


def test_unique_visit_stream(spark, tmp_path):
    rows = [[{"mid": "m", "day": d, "ts": i, "payload": str(i)}] for i, d in enumerate(["d2", "d1", "d1", "d2"])]
    out = stateful.unique_visit_stream(feed(spark, tmp_path, rows, "mid string, day string, ts bigint, payload string"), None)
    assert sorted(r.ts for r in drained(out, tmp_path)) == [0, 1, 3]


def test_bounce_stream(spark, tmp_path):
    rng = random.Random(3)
    events = sorted((rng.randrange(0, 60_000), m, rng.random() < 0.5) for m in "abc" for _ in range(12))
    rows = [[{"mid": m, "ts_ms": t, "entry": e, "payload": ""} for t, m, e in events[i : i + 12]] for i in range(0, len(events), 12)]
    rows += [[{"mid": "z", "ts_ms": 200_000 + i * 50_000, "entry": False, "payload": ""}] for i in range(3)]  # time goes on
    stream = feed(spark, tmp_path, rows, "mid string, ts_ms bigint, entry boolean, payload string").withColumn("time", F.timestamp_millis("ts_ms"))
    out = drained(stateful.bounce_stream(stream), tmp_path)
    for m in "abc":
        own = [(t, e) for t, k, e in events if k == m]
        assert sorted(r.ts_ms for r in out if r.mid == m) == automaton(own, 10_000)
        for r in out:
            if r.mid == m:
                later = [e for t, e in own if r.ts_ms < t < r.ts_ms + 10_000]
                assert r.kind == ("match" if later else "timeout") and (not later or later[0])


def test_interval_join_and_late_rows(spark, tmp_path):
    left = feed(spark, tmp_path, [[{"id": 1, "lt": "2024-01-01T00:01:00Z"}], [{"id": 2, "lt": "2024-01-01T00:02:00Z"}]], "id int, lt timestamp", "l")
    right = feed(spark, tmp_path, [[{"rid": 1, "rt": "2024-01-01T00:01:05Z"}, {"rid": 1, "rt": "2024-01-01T00:01:06Z"}], [{"rid": 2, "rt": "2024-01-01T00:01:55Z"}]], "rid int, rt timestamp", "r")
    out = sj.joined_streams(left, right, F.col("id") == F.col("rid"), "lt", "rt", "5 seconds", "5 seconds")
    assert sorted((r.id, r.rt.second) for r in drained(out, tmp_path)) == [(1, 5), (2, 55)]


def test_windows_drop_late_rows(spark, tmp_path):
    make = lambda *secs: [{"time": f"2024-01-01T00:00:{s:02}Z", "k": "a", "uv_ct": 1, "pv_ct": 0, "sv_ct": 0, "uj_ct": 0, "dur_sum": 0} for s in secs]
    ddl = "time timestamp, k string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint"
    out = sj.windowed_stream([feed(spark, tmp_path, [make(1, 9), make(40), make(5), make(59), make(59)], ddl)], "time", dimensions=("k",))
    assert [(r.stt[14:], r.uv_ct) for r in drained(out, tmp_path)][:1] == [("00:00", 2)]  # second 5 came too late


@pytest.mark.parametrize(("ttl_ms", "kept"), [(3_000, ["0", "1"]), (None, ["0"]), (stateful.DAY_MS, ["0"])])
def test_unique_visit_state_expires(spark, tmp_path, ttl_ms, kept):
    """A second entry of a day counts again once the day is forgotten, and else doesn't; the state can be read."""
    page = lambda n: json.dumps({"common": {"mid": "m"}, "page": {"page_id": str(n)}, "ts": 1_704_067_200_000 + n})
    lines, out = Topics(str(tmp_path / "in")), Topics(str(tmp_path / "out"))

    def put(n):
        lines.put(spark.createDataFrame([("t", page(n))], "topic string, value string"))

    def until(done):
        end = time.time() + 90
        while not done() and time.time() < end:
            time.sleep(0.3)
        assert done()

    put(0)
    start = lambda: streams.start_unique_visit(lines.read(spark, "t", True), out, str(tmp_path / "ck"), ttl_ms)
    found = lambda: sorted(json.loads(r.value)["page"]["page_id"] for r in out.read(spark, "dwm_unique_visit").collect())
    query = start()
    if ttl_ms is None:
        assert query.awaitTermination(120)
    else:  # the job goes on, as its state expires
        until(lambda: found() == ["0"])
    state = spark.read.format("statestore").option("stateVarName", "day").load(str(tmp_path / "ck")).collect()
    assert [(r.key.mid, r.value.value.day if ttl_ms else r.value.day) for r in state] == [("m", "2024-01-01")]
    time.sleep(4)
    put(1)
    if ttl_ms is None:
        query = start()
        assert query.awaitTermination(120)
    else:
        seen = query.lastProgress["batchId"]
        until(lambda: query.lastProgress["batchId"] > seen + 2)
        query.stop()
    assert found() == kept


def test_last_image_stream(spark, tmp_path):
    ddl = "id string, op string, ts bigint, before string, after string"
    rows = [[{"id": "1", "op": "c", "ts": 1, "after": "a"}], [{"id": "1", "op": "d", "ts": 3}, {"id": "1", "op": "u", "ts": 2, "after": "b"}], [{"id": "1", "op": "c", "ts": 4, "after": "c"}, {"id": "2", "op": "u", "ts": 5, "before": "x", "after": "y"}, {"id": "1", "op": "r", "ts": 6, "after": "d"}]]
    out = drained(stateful.with_before_stream(feed(spark, tmp_path, rows, ddl)), tmp_path)
    assert sorted((r.ts, r.op, r.before, r.after) for r in out) == [(1, "c", None, "a"), (2, "u", "a", "b"), (3, "d", "b", None), (4, "c", None, "c"), (5, "u", "x", "y"), (6, "u", "c", "d")]
