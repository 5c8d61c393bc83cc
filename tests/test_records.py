"""Topics with offsets, and dimension tables in versions."""

import json

import pytest
from pyspark.sql import functions as F

from streamloom.dims import DimStore
from streamloom.records import PLACE_BITS, Topics, kafka_start


def put(spark, out, values, batch=None, topic="t", **more):
    rows = [(topic, v, v[:1]) for v in values]
    out.put(spark.createDataFrame(rows, "topic string, value string, key string"), batch, **more)


def values(frame):
    return sorted(r.value for r in frame.collect())


def test_offsets(spark, tmp_path):
    out = Topics(str(tmp_path), partitions=3)
    assert out.read(spark, "t").count() == 0 and out.committed(spark, "t", "g") == {}
    put(spark, out, ["a1", "b1", "a2"])
    put(spark, out, ["a3", "c1"])
    put(spark, out, ["x"], topic="other")
    rows = out.read(spark, "t").collect()
    assert sorted(r.value for r in rows) == ["a1", "a2", "a3", "b1", "c1"] and len({(r.part, r.offset) for r in rows}) == 5
    of = {r.value: r for r in rows}
    assert of["a1"].part == of["a2"].part == of["a3"].part and of["a1"].offset < of["a3"].offset  # a key's records stay in order
    put(spark, out, ["z"], batch=1)  # a batch that runs again replaces what it wrote
    assert values(out.read(spark, "t")) == ["a1", "a2", "b1", "z"]


def test_starts_and_groups(spark, tmp_path):
    out = Topics(str(tmp_path / "t"))
    put(spark, out, ["a", "b"])
    late = out.read(spark, "t", start="latest", pin=str(tmp_path / "pin"))
    put(spark, out, ["c"])
    assert values(late.sparkSession.createDataFrame([], "value string")) == [] and values(out.read(spark, "t", start="latest", pin=str(tmp_path / "pin"))) == ["c"]  # the first beginning stays
    assert values(out.read(spark, "t", start={None: 1 << PLACE_BITS})) == ["c"]
    first = out.read(spark, "t", group="g")
    assert values(first) == ["a", "b", "c"]
    out.commit(first, "t", "g", 0)
    put(spark, out, ["d"])
    assert values(out.read(spark, "t", group="g")) == ["d"] and values(out.read(spark, "t", group="h")) == ["a", "b", "c", "d"]
    assert kafka_start("t", {0: 5, 1: 7}) == {"startingOffsets": json.dumps({"t": {"0": 5, "1": 7}})} and kafka_start("t", "latest") == {"startingOffsets": "latest"}


def test_stream_restarts(spark, tmp_path):
    """A stream that fails in the middle of a batch, after its write, neither loses nor doubles records."""
    lines, out, fail = Topics(str(tmp_path / "in")), Topics(str(tmp_path / "out")), [True]

    class Failing(Topics):
        def put(self, rows, batch=None, at=None):
            super().put(rows, batch, at)
            if batch == 1 and fail.pop():
                raise RuntimeError("lost after the write")

    sink = Failing(str(tmp_path / "out"))
    for n in range(3):
        put(spark, lines, [f"v{n}", f"w{n}"])
        read = lambda: lines.read(spark, "t", True, pin=str(tmp_path / "pin")).select("value")
        if n == 1:
            with pytest.raises(Exception, match="lost after the write"):
                sink.stream(read(), str(tmp_path / "ck"), "t").awaitTermination(120)
            assert values(out.read(spark, "t")) == ["v0", "v1", "w0", "w1"]  # written, though not committed
        assert out.stream(read(), str(tmp_path / "ck"), "t").awaitTermination(120)
    assert values(out.read(spark, "t")) == ["v0", "v1", "v2", "w0", "w1", "w2"]


def test_dimension_buckets(spark, tmp_path):
    store = DimStore(str(tmp_path), buckets=8)

    def merge(batch, rows):
        made = [("t", None, {"id": k, "v": v}, ts) for k, v, ts in rows]
        store.merge(spark.createDataFrame(made, "sink_table string, sink_pk string, after map<string,string>, ts_ms bigint"), batch)

    now = lambda **k: dict(map(tuple, store.read(spark, "t", ["id", "v"], **k).collect()))
    merge(0, [(str(i), "a", 1) for i in range(40)])
    merge(1, [("3", "old", 1), ("3", "b", 2), ("99", "n", 1)])
    assert now() == {str(i): "a" for i in range(40)} | {"3": "b", "99": "n"} and now(version=0) == {str(i): "a" for i in range(40)}
    held = store.manifest(spark)
    moved = {b for (_, b), batch in held.items() if batch == 1}
    assert 1 <= len(moved) <= 2 and len(held) == 8  # only the buckets of two keys were written anew
    merge(1, [("5", "c", 9)])  # the batch runs again with other rows, and replaces itself
    assert now() == {str(i): "a" for i in range(40)} | {"5": "c"}
    keys = spark.createDataFrame([("5",), ("5",), (None,)], "k string")
    some = store.read(spark, "t", ["id", "v"], keys)
    assert 0 < len(some.inputFiles()) <= 2 and dict(map(tuple, some.collect()))["5"] == "c"
    assert store.read(spark, "none", ["id"]).count() == 0
    merge(2, [])
    assert store.versions(spark) == [0, 1]


def test_vacuum_of_dimension_versions(spark, tmp_path):
    store, want = DimStore(str(tmp_path), buckets=4), {}

    def merge(batch, keys):
        made = [("t", None, {"id": k, "v": str(batch)}, batch) for k in keys]
        store.merge(spark.createDataFrame(made, "sink_table string, sink_pk string, after map<string,string>, ts_ms bigint"), batch)
        want[batch] = want.get(batch - 1, {}) | {k: str(batch) for k in keys}

    now = lambda **k: dict(map(tuple, store.read(spark, "t", ["id", "v"], **k).collect()))
    held = lambda: {tuple(int(p.name.partition("=")[2]) for p in (f.parent.parent, f)) for f in tmp_path.glob("data/*/*/bucket=*")}
    assert store.vacuum(spark) == 0
    merge(0, [str(i) for i in range(20)])
    for batch in (1, 2, 3):
        merge(batch, ["7"])
    before, bucket = held(), next(b for (_, b), batch in store.manifest(spark).items() if batch == 3)
    with pytest.raises(ValueError):
        store.vacuum(spark, 1)
    (tmp_path / "data/batch=4/sink_table=t/bucket=0").mkdir(parents=True)  # being written
    assert store.vacuum(spark, 2) == 2 and held() == before - {(0, bucket), (1, bucket)} | {(4, 0)}
    assert store.versions(spark) == [2, 3] and now() == want[3] and now(version=2) == want[2]
    merge(3, ["8"])  # the last batch runs again
    assert now() == want[2] | {"8": "3"}
    assert store.vacuum(spark, 2) == 0


def test_enrich_reads_what_keys_need(spark, tmp_path):
    from streamloom.operators.joins import Lookup, enrich

    store = DimStore(str(tmp_path), buckets=8)
    rows = [("t", None, {"id": str(i), "name": f"n{i}"}, 1) for i in range(20)]
    store.merge(spark.createDataFrame(rows, "sink_table string, sink_pk string, after map<string,string>, ts_ms bigint"), 0)
    asked = []

    def dims(table, keys):
        asked.append(store.read(spark, table, ["id", "name"], keys))
        return asked[-1]

    found = enrich(spark.createDataFrame([(3,), (4,), (77,)], "k int"), dims, [Lookup("t", "id", "k", {"name": "name"})], "left")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(3, "n3"), (4, "n4"), (77, None)], key=str) and len(asked[0].inputFiles()) <= 3
    assert found.select(F.count("*")).first()[0] == 3
