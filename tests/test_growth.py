"""What showed on larger tables only."""

import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from streamloom import job_queries, schemas
from streamloom.catalogue import ORACLE_SQL, QUERIES
from streamloom.functions import scalars as S
from streamloom.operators import cdc
from streamloom.plans import jobs
from streamloom.records import Topics
from streamloom.sinks import encoded, write_topic
from streamloom.sources.topics import read_topic
from streamloom.streaming import jobs as streams
from streamloom.streaming import stateful
from streamloom.streaming.joins import RISING


@pytest.mark.parametrize("name", ["topic_group", "dimension_versions"])
@pytest.mark.parametrize("n", [12])
def test_cut_of_events(spark, tmp_path, name, n):
    """The parts are those of the SQL whatever the greatest id leaves when it is divided by three."""
    where, duck = str(tmp_path / "events.parquet"), duckdb.connect()
    duck.execute(f"copy (select range as event_id, timestamp '2024-01-01' + to_hours(range) as ts, 5 as user_id, case when range % 4 = 0 then 'view' else 'click' end as event_type, 1.5 as value from range({n})) to '{where}' (format parquet)")
    duck.execute(f"create view events as select * from '{where}'")
    frame, found = QUERIES[name](spark, str(tmp_path)), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


class Handle:
    """States of one key in memory, with a count of the calls on them."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, *_):
        return Value(self)

    def getListState(self, *_):
        return Values(self)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class Value:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _called(self, result=None):
        self.handle.calls += 1
        return result

    def get(self):
        return self._called(self.value)

    def exists(self):
        return self._called(self.value is not None)

    def update(self, value):
        self.value = self._called(tuple(value))

    def clear(self):
        self.value = self._called()


class Values(Value):
    def get(self):
        return iter(self._called(self.value or ()))

    def appendValue(self, value):
        self.value = self._called((*(self.value or ()), tuple(value)))

    def appendList(self, values):
        self.value = self._called((*(self.value or ()), *values))

    put = Value.update


@pytest.mark.parametrize("processor", [stateful.NewVisitorRepair(), stateful.DailyUnique(None), stateful.Bounces(5), stateful.LastImage()])
def test_calls_on_state_are_by_key(processor):
    handle = Handle()
    processor.init(handle)
    rows = [Row(mid="m", id="m", is_new="1", day=str(i // 9), ts=i, ts_ms=i, entry=True, payload=str(i), op="u", before=None, after=str(i)) for i in range(500)]
    out = [*processor.handleInputRows(("m",), iter(rows), None)]
    assert handle.calls <= 4
    if isinstance(processor, stateful.Bounces):
        assert handle.timers == {0}
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 450, getExpiryTimeInMs=lambda: 0)
        out, handle.calls = [*processor.handleExpiredTimer(("m",), now, now)], 0
        assert [r.ts_ms for r in out] == [*range(450)] and 451 in handle.timers
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 9_000, getExpiryTimeInMs=lambda: 451)
        out = [*processor.handleExpiredTimer(("m",), now, now)]
        assert [(r.ts_ms, r.kind) for r in out] == [*((i, "match") for i in range(450, 499)), (499, "timeout")] and handle.calls <= 6
    else:
        assert len(out) == (56 if isinstance(processor, stateful.DailyUnique) else 500)


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_parsed_once(spark):
    """Conditions of joins and filters take no copies of the parsing down to the scan."""
    lines = spark.range(3).selectExpr("concat('{\"id\":', id, ',\"op\":\"c\"}') as value")
    pairs = jobs.order_pairs(lines, lines)
    assert _plan(pairs).count("from_json(") == 2
    assert _plan(jobs.payment_wide(lines, pairs)).count("from_json(") == 3
    assert _plan(cdc.without_deletes(cdc.decode_changes(lines))).count("from_json(") == 1
    assert _plan(lines.select(S.typed_json(F.col("value"), "id bigint, op string, user_id bigint").alias("r")).select("r.*")).count("parse_json") <= 1


def test_line_files_are_compressed(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "'a name' as sku_name", "'2024-01-01 00:00:00' as create_time")
    write_topic(rows, str(tmp_path / "t"))
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("part-*")) < 20_000 * 60 / 4
    assert read_topic(spark, str(tmp_path / "t")).distinct().count() == 20_000


def test_pairs_of_streams_without_state_by_row(spark, tmp_path):
    """Batches that overlap in time, with late rows and a batch that runs again: the pairs of Spark's own stateful join,
    while only rows that can still meet another are held."""
    rng, session = random.Random(7), job_queries.stream_session(spark)
    topics, own, out = [Topics(str(tmp_path / n)) for n in "pw"], Topics(str(tmp_path / "own")), Topics(str(tmp_path / "out"))
    ddl = ("id bigint, order_id bigint, create_time string", "order_id bigint, detail_id bigint, create_time string")

    def start():
        p, w = [t.read(session, "rows", True) for t in topics]
        wide = S.apart(w, F.from_json("value", schemas.ORDER_WIDE))
        own.stream(encoded(jobs.payment_wide(p, wide, delay=RISING)), str(tmp_path / "native"), "made").awaitTermination()
        query = streams.start_payment_wide(p, w, out, str(tmp_path / "ck"), topic="made")
        query.awaitTermination()
        return query

    for n in range(3):
        for topic, columns in zip(topics, ddl):
            if (n, topic) != (1, topics[1]):  # one batch has one side only
                rows = [(i, i % 5, f"2024-01-01 {10 + n}:{rng.randrange(60):02}:{rng.randrange(60):02}") for i in range(40)]
                rows += [(99, 3, "2024-01-01 10:30:00"), (98, None, "2024-01-01 11:00:00"), (97, 3, None)]
                if topic is topics[1]:
                    rows = [(b, a, t) for a, b, t in rows]
                topic.put(encoded(spark.createDataFrame(rows, columns)).withColumn("topic", F.lit("rows")))
        query = start()
        assert all(not p["stateOperators"] for p in query.recentProgress)
    made = [sorted(r.value for r in t.read(spark, "made").collect()) for t in (own, out)]
    assert made[0] == made[1] and len(made[0]) > 30
    held = spark.read.parquet(str(tmp_path / "ck/waiting/rows=2"))
    assert 0 < held.count() < 60  # of 215
    next((tmp_path / "ck/commits").glob("2")).unlink()  # as if the last batch had been broken off
    (tmp_path / "ck/commits/.2.crc").unlink(missing_ok=True)
    start()
    assert sorted(r.value for r in out.read(spark, "made").collect()) == made[0]
