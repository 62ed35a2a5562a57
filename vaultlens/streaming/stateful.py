"""Feeds, retries and barriers as streams with state and timers, and a sink that writes each batch once.

State is kept by key in RocksDB, as values, lists and maps; it is read and written by the rows that arrive, never as a whole, but for the rows
that wait for their turn, which are kept by the block. A query that is killed goes on from its checkpoint: what was written before isn't written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .feeds import BACKOFF

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 10_000  #: Fixed value: rows of a block that waits, and of a frame that is told.
HEARTBEAT = 15.0  #: Fixed value: seconds without a word after which a feed says that it is there.


def session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state, so that no setting of the caller's changes."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = [c.strip().split(" ") for c in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pd.DataFrame({name: pd.array(list(v), dtype="Int64") if kind == "long" else pd.Series(v, dtype=object) for (name, kind), v in zip(kinds, columns, strict=True)})


def _packed(rows: pa.Table) -> bytes:
    """A block of rows as bytes, since state is written and read by the value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


class StatusFeed(StatefulProcessor):
    """Changes of documents' status and of their deal's index, in the order of time whatever the order of arrival.

    Rows wait in a list of blocks, each with its earliest time, until the watermark has passed them; one timer stands for the earliest. A map has each document's last status, a value the
    number of documents and of those that are done, which is the index status; it is told when it differs.
    """

    OUT = "deal long, kind string, document long, status string, at_us long, documents long, done long"

    def __init__(self, done: str):
        self.of_done = done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "least long, block binary")
        self.last = handle.getMapState("last", "document long", "status string")
        self.index = handle.getValueState("index", "documents long, done long")

    def _add(self, rows: pa.Table) -> list[int]:
        """Blocks of rows put to those that wait, and the earliest time of each."""
        out = []
        for at in range(0, rows.num_rows, BLOCK):
            block = rows.slice(at, BLOCK)
            out.append(pc.min(block["at_us"]).as_py())
            self.waiting.appendValue((out[-1], _packed(block)))
        return out

    def _await(self, times: list[int], others: list[int]) -> None:
        """One timer, for the earliest of microseconds and of the timers that stand and are still wanted."""
        old = list(self.handle.listTimers())
        first = min([t // 1000 for t in times] + others, default=None)
        for timer in old:
            if timer != first:
                self.handle.deleteTimer(timer)
        if first is not None and first not in old:
            self.handle.registerTimer(first)

    def _due(self, watermark: int) -> pa.Table | None:
        """Rows up to the watermark in the order of time; the rest goes on waiting."""
        blocks = list(self.waiting.get()) if self.waiting.exists() else []
        later = [b for b in blocks if b[0] // 1000 > watermark]
        opened = [_unpacked(bytes(b[1])) for b in blocks if b[0] // 1000 <= watermark]
        self.waiting.clear()
        for b in later:
            self.waiting.appendValue((b[0], bytes(b[1])))
        times, due = [b[0] for b in later], None
        if opened:
            rows = pa.concat_tables(opened).combine_chunks()
            passed = pc.less(rows["at_us"], (watermark + 1) * 1000)
            times += self._add(rows.filter(pc.invert(passed)))
            due = rows.filter(passed).sort_by([("at_us", "ascending"), ("document", "ascending"), ("status", "ascending")])
        self._await(times, [])
        return due

    def _told(self, deal: int, due: pa.Table) -> Iterator[list[tuple]]:
        seen, changed = {}, False
        documents, done = self.index.get() if self.index.exists() else (0, 0)
        for first in range(0, due.num_rows, BLOCK):
            out, block = [], due.slice(first, BLOCK)
            for at, document, status in zip(*(block[c].to_pylist() for c in ("at_us", "document", "status")), strict=True):
                if document not in seen:
                    was = self.last.getValue((document,))
                    seen[document] = was[0] if was else None
                before = seen[document]
                if before == status:
                    continue
                seen[document] = status
                out.append((deal, "document", document, status, at, None, None))
                now = (documents + (before is None), done + (status == self.of_done) - (before == self.of_done))
                if now != (documents, done):
                    documents, done = now
                    out.append((deal, "index", None, None, at, documents, done))
            changed = changed or bool(out)
            yield out
        for document, status in seen.items():
            self.last.updateValue((document,), (status,))
        if changed:
            self.index.update((documents, done))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = pa.schema([("at_us", pa.int64()), ("document", pa.int64()), ("status", pa.string())])
        times = []
        for b in rows:
            times += self._add(pa.Table.from_pandas(b[kinds.names], schema=kinds, preserve_index=False).replace_schema_metadata())
        self._await(times, list(self.handle.listTimers()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due(timerValues.getCurrentWatermarkInMs())
        for out in self._told(int(key[0]), due) if due is not None else ():
            if out:
                yield _frame(out, self.OUT)


def status_feed(log: DataFrame, done: str, late: str = "1 hour") -> DataFrame:
    """(deal, kind, document, status, at_us, documents, done) of a stream (deal, document, status, at). Rows later than ``late`` are dropped; at_us are microseconds."""
    rows = log.withWatermark("at", late).select("deal", "document", "status", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("deal").transformWithStateInPandas(StatusFeed(done), StatusFeed.OUT, "append", "eventtime")


class Heartbeat(StatefulProcessor):
    """A row for a deal whenever nothing has been heard of it for a while."""

    OUT = "deal long, beats long"

    def __init__(self, seconds: float):
        self.every = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "n long")

    def _again(self, now: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.every)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        self._again(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = (self.beats.get()[0] if self.beats.exists() else 0) + 1
        self.beats.update((n,))
        self._again(timerValues.getCurrentProcessingTimeInMs())
        yield _frame([(int(key[0]), n)], self.OUT)


def heartbeat(log: DataFrame, seconds: float = HEARTBEAT) -> DataFrame:
    """(deal, beats): how often each deal of a stream (deal) has been silent for so long."""
    return log.select("deal").groupBy("deal").transformWithStateInPandas(Heartbeat(seconds), Heartbeat.OUT, "append", "processingtime")


class Retries(StatefulProcessor):
    """Failures of jobs: each but the last is queued again when its time has come, by a timer; the last one is a dead letter."""

    OUT = "job long, attempt long, state string, wait_ms long"

    def __init__(self, most: int, base: float):
        self.most, self.base = most, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, out = self.attempts.get()[0] if self.attempts.exists() else 0, []
        for _ in range(sum(len(b) for b in rows)):
            n += 1
            if n < self.most:
                wait = int(self.base * 2**n * 1000)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)
                out.append((int(key[0]), n, "waiting", wait))
            else:
                out.append((int(key[0]), n, "failed" if n == self.most else "late", None))
        self.attempts.update((n,))
        if out:
            yield _frame(out, self.OUT).astype({"wait_ms": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([(int(key[0]), self.attempts.get()[0], "queued", None)], self.OUT).astype({"wait_ms": "Int64"})


def retries(failures: DataFrame, most: int = 3, base: float = BACKOFF) -> DataFrame:
    """(job, attempt, state, wait_ms) of a stream of failures (job): waiting, and queued when the wait is over; failed for good; late."""
    return failures.select("job").groupBy("job").transformWithStateInPandas(Retries(most, base), Retries.OUT, "append", "processingtime")


class Barrier(StatefulProcessor):
    """Opens for a deal whenever its last open document comes to an end, once for each number of documents."""

    OUT = "deal long, documents long, idempotency_key string"

    def __init__(self, ends: tuple[str, ...]):
        self.ends = ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "document long", "is_open boolean")
        self.count = handle.getValueState("count", "documents long, waiting long")
        self.opened = handle.getMapState("opened", "documents long", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        documents, waiting = self.count.get() if self.count.exists() else (0, 0)
        seen, out = {}, []
        for at, document, status in sorted((int(a), int(d), s) for b in rows for a, d, s in zip(b["at_us"], b["document"], b["status"], strict=True)):
            if document not in seen:
                seen[document] = self.open.getValue((document,))[0] if self.open.containsKey((document,)) else None
            before, now = seen[document], status not in self.ends
            documents, waiting, seen[document] = documents + (before is None), waiting + int(now) - int(bool(before)), now
            if not now and not waiting and not self.opened.containsKey((documents,)):
                self.opened.updateValue((documents,), (True,))
                out.append((int(key[0]), documents, f"index:{key[0]}:{documents}"))
        for document, is_open in seen.items():
            self.open.updateValue((document,), (bool(is_open),))
        self.count.update((documents, waiting))
        if out:
            yield _frame(out, self.OUT)


def barrier(log: DataFrame, ends: tuple[str, ...] = ("parsed", "failed", "unsupported")) -> DataFrame:
    """(deal, documents, idempotency_key) of a stream (deal, document, status, at): what waits for all documents of a deal may begin."""
    rows = log.select("deal", "document", "status", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("deal").transformWithStateInPandas(Barrier(ends), Barrier.OUT, "append", "none")


def exactly_once(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes each batch to a folder of its own, named by the batch's number.

    A batch that is run again after a crash overwrites what its first run left, and the ledger, one empty file a batch, is written last: readers take what the ledger names.
    ``then`` is called before the ledger is, for the batch's other effects.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        if then is not None:
            then(kept, number)
        kept.sparkSession.range(number, number + 1).withColumnRenamed("id", "batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        kept.unpersist()

    return write


def written(spark: SparkSession, path: str) -> DataFrame:
    """What ``exactly_once`` has finished writing, with ``batch``."""
    done = spark.read.option("recursiveFileLookup", "true").schema("batch long").parquet(f"{path}/ledger")
    return spark.read.option("basePath", f"{path}/batches").parquet(f"{path}/batches").withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(done.distinct()), "batch", "left_semi")
