"""Streams with state and timers: order, restarts, crashes, retries and barriers."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from vaultlens.streaming import stateful

SCHEMA = "deal long, document long, status string, at timestamp"
START = datetime.datetime(2025, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def log(n=200, seed=2):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(8), rng.choice(["queued", "parsing", "parsed", "failed"]), i * 60) for i in range(n)]


def micros(seconds):
    return int(at(seconds).replace(tzinfo=datetime.UTC).timestamp() * 1e6)


def told(rows, done, until):
    """The feed of rows in the order of time, up to a second."""
    last, index, out = {}, {}, []
    for deal, document, status, t in sorted(rows, key=lambda r: (r[3], r[1])):
        before = last.get((deal, document))
        if t > until or before == status:
            continue
        last[deal, document] = status
        out.append((deal, "document", document, status, micros(t), None, None))
        docs, ended = index.get(deal, (0, 0))
        now = (docs + (before is None), ended + (status == done) - (before == done))
        if now != (docs, ended):
            index[deal] = now
            out.append((deal, "index", None, None, micros(t), *now))
    return sorted(map(repr, out))


class Room:
    """A folder of files that a stream reads one by one."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows):
        self.spark.createDataFrame([(d, x, s, at(t)) for d, x, s, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        time.sleep(0.05)  # files are read in the order of their times

    def start(self, plan, then=None, **trigger):
        own = stateful.session(self.spark)
        stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        return plan(stream).writeStream.foreachBatch(stateful.exactly_once(f"{self.path}/out", then)).option("checkpointLocation", f"{self.path}/state").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def got(self):
        return [tuple(r) for r in stateful.written(self.spark, f"{self.path}/out").drop("batch").collect()]


@pytest.fixture
def room(spark, tmp_path):
    return Room(spark, tmp_path)


def test_a_feed_is_in_order_and_goes_on_after_a_restart_and_a_crash(room):
    rows = log()
    rng = random.Random(5)
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randrange(1200))  # up to twenty minutes late
    feed = lambda s: stateful.status_feed(s, "parsed", "1 hour")
    for k in range(0, 100, 50):
        room.add(shuffled[k : k + 50])
    room.start(feed).awaitTermination()
    first = room.got()
    for k in range(100, 200, 50):
        room.add(shuffled[k : k + 50])
    room.add([(9, 9, "last", 200 * 60 + 7200)])

    def crash(batch, number):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        room.start(feed, crash).awaitTermination()
    assert sorted(room.got()) == sorted(first)  # the crashed batch isn't in the ledger
    room.start(feed).awaitTermination()
    assert sorted(map(repr, room.got())) == told(rows, "parsed", 10**9)
    assert room.spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.PROVIDER


def test_rows_wait_for_the_watermark(room):
    rows = [(1, 1, "queued", 0), (1, 2, "queued", 4000), (1, 1, "parsed", 8000), (1, 1, "failed", 100)]
    for r in rows[:3]:
        room.add([r])
    room.add(rows[3:])  # over an hour behind what has been seen
    room.start(lambda s: stateful.status_feed(s, "parsed", "1 hour")).awaitTermination()
    assert sorted(map(repr, room.got())) == told(rows[:3], "parsed", 8000 - 3600)


def test_rows_wait_by_the_block_and_large_numbers_stay_whole():
    import pyarrow as pa

    class State(list):
        exists, get = list.__len__, list.__iter__
        appendValue = list.append

    class Handle:
        def __init__(self):
            self.timers = set()
            self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(self.timers), self.timers.add, self.timers.discard

    feed = stateful.StatusFeed("b")
    feed.handle, feed.waiting = Handle(), State()
    rows = pa.table({"at_us": [i * 1000 for i in range(25_000)], "document": [2**60 + 1] * 25_000, "status": ["a"] * 25_000})
    feed._await(feed._add(rows), [])
    assert len(feed.waiting) == 3 and feed.handle.timers == {0}  # 25,000 values before
    due = feed._due(14_999)
    assert due.num_rows == 15_000 and due["at_us"].to_pylist() == rows["at_us"].to_pylist()[:15_000]
    assert len(feed.waiting) == 2 and feed.handle.timers == {15_000}
    assert feed._due(24_999).num_rows == 10_000 and not feed.waiting and not feed.handle.timers
    assert stateful._frame([(1, "document", 2**60 + 1, "a", 0, None, None), (1, "index", None, None, 0, 1, 0)], stateful.StatusFeed.OUT)["document"][0] == 2**60 + 1


def awaited(query, room, enough, seconds=40):
    """The rows once they are enough, while the query runs."""
    deadline = time.time() + seconds
    while time.time() < deadline:
        if query.lastProgress and enough(rows := room.got()):
            return rows
        assert query.exception() is None
        time.sleep(0.3)
    raise AssertionError("the rows didn't come")


def test_retries_come_back_by_timers(room):
    room.add([(0, 0, "x", 0)])
    query = room.start(lambda s: stateful.retries(s.select(F.col("document").alias("job")), 3, 0.2), processingTime="100 milliseconds")
    try:
        awaited(query, room, lambda rows: (0, 1, "queued", None) in rows)
        room.add([(0, 0, "x", 0)])
        awaited(query, room, lambda rows: (0, 2, "queued", None) in rows)
        room.add([(0, 0, "x", 0), (0, 0, "x", 0)])
        rows = awaited(query, room, lambda rows: len(rows) == 6)
    finally:
        query.stop()
    assert sorted(map(repr, rows)) == sorted(map(repr, [(0, 1, "waiting", 400), (0, 1, "queued", None), (0, 2, "waiting", 800), (0, 2, "queued", None), (0, 3, "failed", None), (0, 4, "late", None)]))


def test_a_silent_deal_beats(room):
    room.add([(7, 0, "x", 0)])
    query = room.start(lambda s: stateful.heartbeat(s, 0.3), processingTime="100 milliseconds")
    try:
        rows = awaited(query, room, lambda rows: len(rows) >= 2)
    finally:
        query.stop()
    assert sorted(rows)[:2] == [(7, 1), (7, 2)]


def test_a_barrier_opens_once_for_each_number_of_documents(room):
    ends = ("parsed", "failed")
    rows = [(1, 1, "queued", 1), (1, 2, "queued", 2), (1, 1, "parsed", 3), (1, 2, "failed", 4), (1, 2, "queued", 5), (1, 2, "parsed", 6), (2, 1, "parsed", 7), (1, 3, "parsed", 8), (3, 1, "queued", 9)]
    for k in range(0, len(rows), 3):
        room.add(rows[k : k + 3])
    room.start(lambda s: stateful.barrier(s, ends)).awaitTermination()
    assert sorted(room.got()) == [(1, 2, "index:1:2"), (1, 3, "index:1:3"), (2, 1, "index:2:1")]
