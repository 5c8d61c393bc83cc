"""Keyed state of the log jobs: new-visitor repair, daily unique visitors, bounces.

Every call on a state is a message to the JVM, so a key's state is read once and written once in a batch,
however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Rows that wait are put into the state so many at a time.
CHUNK = 1000


class NewVisitorRepair(StatefulProcessor):
    """Only a device's first row flagged ``1`` stays so. ``ttl_ms`` bounds the state; None keeps it."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = known = self.seen.exists()
        for row in sorted(rows, key=lambda r: r.ts):
            flag = row.is_new
            if flag == "1":
                flag, seen = "0" if seen else "1", True
            yield Row(mid=row.mid, is_new=flag, ts=row.ts, payload=row.payload)
        if seen and not known:
            self.seen.update((True,))

    def close(self) -> None:
        pass


class DailyUnique(StatefulProcessor):
    """A device's entry rows of another day than its entry before; the day is forgotten a day after its last write."""

    def __init__(self, ttl_ms: int | None = DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.day.get()
        day = None if last is None else last[0]
        for row in sorted(rows, key=lambda r: r.ts):
            if day is None or day != row.day:
                yield Row(mid=row.mid, day=row.day, ts=row.ts, payload=row.payload)
            day = row.day
        self.day.update((day,))

    def close(self) -> None:
        pass


class Bounces(StatefulProcessor):
    """Entries that no other page of the device follows within a time, decided in order of event time: of
    kind ``match`` where another entry follows in time, of kind ``timeout`` where nothing does.

    Rows wait until the watermark has passed them; one entry at most waits for its successor. A device
    has one timer, for the first time at which something of it can be decided: when it fires, all rows
    that the watermark has passed are, so a row is read once or twice, however many wait."""

    def __init__(self, within_ms: int = 10_000):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, entry boolean, payload string")
        # the time of the timer, and the entry that waits for its successor
        self.mark = handle.getValueState("mark", "timer bigint, ts bigint, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, some = None, []
        for row in rows:
            some.append((row.ts_ms, row.entry, row.payload))
            first = row.ts_ms if first is None else min(first, row.ts_ms)
            if len(some) == CHUNK:
                self.waiting.appendList(some)
                some = []
        if some:
            self.waiting.appendList(some)
        mark = self.mark.get()
        timer, *entry = mark or (None, None, None)
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.mark.update((first, *entry))
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        mark = self.mark.get()
        entry = None if mark is None or mark[1] is None else mark[1:]
        out = []
        for ts, is_entry, payload in due:
            late = entry is not None and ts - entry[0] >= self.within_ms
            if late or entry is not None and is_entry:
                out.append(Row(mid=key[0], ts_ms=entry[0], payload=entry[1], kind="timeout" if late else "match"))
            entry = (ts, payload) if is_entry else None
        if entry is not None and now >= entry[0] + self.within_ms:
            out.append(Row(mid=key[0], ts_ms=entry[0], payload=entry[1], kind="timeout"))
            entry = None
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        times = [r[0] for r in later[:1]] + ([] if entry is None else [entry[0] + self.within_ms])
        if times:
            self.mark.update((min(times), *(entry or (None, None))))
            self.handle.registerTimer(min(times))
        elif mark is not None:
            self.mark.clear()
        return iter(out)

    def close(self) -> None:
        pass


class LastImage(StatefulProcessor):
    """The image before each change, remembered by key: a log of new images becomes one of both. Images are
    JSON texts. State holds one image a key, none after a delete; ``ttl_ms`` bounds it further."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "image string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        before = known = None if held is None else held[0]
        written = False
        for row in sorted(rows, key=lambda r: r.ts):
            op = "u" if row.op in ("c", "r") and known is not None else row.op
            yield Row(id=row.id, op=op, ts=row.ts, before=row.before if known is None else known, after=row.after)
            if row.op == "d":
                known, written = None, True
            elif row.after is not None:
                known, written = row.after, True
        if written and known is not None:
            self.last.update((known,))
        elif written and before is not None:
            self.last.clear()

    def close(self) -> None:
        pass


def _mode(ttl_ms: int | None) -> str:
    """State that expires keeps a stream awake: Spark then runs empty batches without end, so it needs a
    trigger that goes on. Without expiry a stream ends with its input."""
    return "none" if ttl_ms is None else "processingTime"


def repaired_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``mid``, ``is_new``, ``ts``, ``payload``, as they come; rows of one batch in order of ts."""
    return rows.groupBy("mid").transformWithState(NewVisitorRepair(ttl_ms), "mid string, is_new string, ts bigint, payload string", "append", _mode(ttl_ms))


def unique_visit_stream(entries: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Entry rows as ``mid``, ``day``, ``ts``, ``payload``."""
    return entries.groupBy("mid").transformWithState(DailyUnique(ttl_ms), "mid string, day string, ts bigint, payload string", "append", _mode(ttl_ms))


def unique_visits_simple(entries: DataFrame, ts: str = "time") -> DataFrame:
    """The simpler form, for input in order: a device and day once."""
    return entries.withWatermark(ts, "1 day").dropDuplicatesWithinWatermark(["mid", "day"])


def bounce_stream(rows: DataFrame, within_ms: int = 10_000, delay: str = "1001 milliseconds") -> DataFrame:
    """Rows ``mid``, ``time`` (timestamp), ``ts_ms``, ``entry``, ``payload``; results ``mid``, ``ts_ms``, ``payload``, ``kind``."""
    marked = rows.withWatermark("time", delay)
    return marked.groupBy("mid").transformWithState(Bounces(within_ms), "mid string, ts_ms bigint, payload string, kind string", "append", "eventTime")


def with_before_stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes ``id``, ``op``, ``ts``, ``before``, ``after`` (images as JSON texts), as ``operators.cdc.with_before`` completes them."""
    return rows.groupBy("id").transformWithState(LastImage(ttl_ms), "id string, op string, ts bigint, before string, after string", "append", _mode(ttl_ms))
