"""Status feeds, queues and windows, each as a batch plan and as a stream.

The batch forms take the whole log and say what the stream would have emitted; the streams use watermarks and state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BACKOFF = 5  #: seconds; doubled with each attempt


def status_changes(log: DataFrame, key: str = "key", status: str = "status", order: str = "at") -> DataFrame:
    """Rows of the log whose status differs from the key's one before, first rows included."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumn("was", F.lag(status).over(w)).filter(~F.col("was").eqNullSafe(F.col(status)))


def status_feed(stream: DataFrame) -> DataFrame:
    """(key, status, at) of a stream of (key, status, at) where the status is new. State: the last status of each key."""

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            rows = b.sort_values("at")
            new = rows.status.ne(rows.status.shift(fill_value=last))
            if len(rows):
                last = rows.status.iloc[-1]
            if new.any():
                yield rows.loc[new, ["key", "status", "at"]]
        if last is not None:
            state.update((last,))

    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").applyInPandasWithState(changed, f"key {kind}, status string, at timestamp", "status string", "append", "NoTimeout")


def attempts(failures: DataFrame, most: int = 3, key: str = "key", order: str = "at") -> DataFrame:
    """Each failure with its attempt, what becomes of the job (queued, failed, late) and when it may run again."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    out = failures.withColumn("attempt", n)
    state = F.when(F.col("attempt") < most, "queued").when(F.col("attempt") == most, "failed").otherwise("late")
    return out.withColumn("state", state).withColumn("wait", F.when(F.col("attempt") < most, (BACKOFF * F.pow(F.lit(2), F.col("attempt"))).cast("int")))


def claimed(jobs: DataFrame, now: str, most: int = 4) -> DataFrame:
    """The jobs that a worker takes next: queued and due, or locked for over 15 minutes, the oldest first."""
    at = F.lit(now).cast("timestamp")
    due = ((F.col("status") == "queued") & (F.col("run_after") <= at)) | ((F.col("status") == "running") & (F.col("locked_at") < at - F.expr("INTERVAL 15 MINUTES")))
    return jobs.filter(due).orderBy("created_at", "job_id").limit(most)


def idempotent(jobs: DataFrame, key: str = "idempotency_key", order: str = "at") -> DataFrame:
    """The first job of each key."""
    rest = [c for c in jobs.columns if c != key]
    return jobs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("j")).select(key, "j.*")


def idempotent_stream(jobs: DataFrame, key: str = "idempotency_key", at: str = "at", late: str = "1 hour") -> DataFrame:
    return jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, value: str, at: str = "at", size: str = "1 day", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(keys.., window_start, window_end, total, n). With ``late``, rows behind the watermark are dropped and state is bounded."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if late else events
    out = rows.groupBy(*keys, F.window(at, size).alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "n")


def sessions(events: DataFrame, key: str, at: str = "at", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n) of events less than the gap apart."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if late else events
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def complete(documents: DataFrame, by: str = "deal_id") -> DataFrame:
    """Deals whose documents all came to an end: what waits for them may begin."""
    open_ = F.count_if(~F.col("status").isin("parsed", "failed", "unsupported"))
    return documents.groupBy(by).agg(open_.alias("open"), F.count(F.lit(1)).alias("documents")).filter("open = 0").drop("open")


def with_deals(stream: DataFrame, deals: DataFrame, key: str = "deal_id") -> DataFrame:
    """Stream-static join; Spark broadcasts the static side below its size threshold."""
    return stream.join(deals, key, "left")


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and rows with an error for the dead-letter table."""
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null")
