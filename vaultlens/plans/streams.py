"""Queries over the event log, and the same through Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import shared_folder
from ..streaming import feeds, stateful
from .adapters import read

S = SparkSession
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def log(s: S, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("order"), F.col("ts").alias("at"), "event_id", F.col("value").cast("decimal(24,6)").alias("value"))


@query("WITH w AS (SELECT event_id, user_id AS key, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT event_id, key, status, was FROM w WHERE was IS DISTINCT FROM status")
def status_change_feed(s: S, d: str) -> DataFrame:
    return feeds.status_changes(log(s, d), order="order").select("event_id", "key", "status", "was")


@query("""WITH f AS (SELECT event_id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE value < 20)
SELECT event_id, key, attempt, CASE WHEN attempt < 3 THEN 'queued' WHEN attempt = 3 THEN 'failed' ELSE 'late' END AS state, CASE WHEN attempt < 3 THEN CAST(5 * 2 ** attempt AS INTEGER) END AS wait FROM f""")
def retry_dead_letter(s: S, d: str) -> DataFrame:
    return feeds.attempts(log(s, d).filter("value < 20"), order="order").select("event_id", "key", "attempt", "state", "wait")


@query("SELECT user_id || ':' || event_type AS idempotency_key, arg_min(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS event_id FROM events GROUP BY 1")
def dedupe_idempotent(s: S, d: str) -> DataFrame:
    jobs = log(s, d).select(F.concat_ws(":", F.col("key").cast("string"), "status").alias("idempotency_key"), "event_id", "order")
    return feeds.idempotent(jobs, order="order").select("idempotency_key", "event_id")


@query("SELECT event_type AS status, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DECIMAL(38,6)) AS total, count(*) AS n FROM events GROUP BY ALL")
def inflow_tumbling(s: S, d: str) -> DataFrame:
    return feeds.tumbling(log(s, d), "value", keys=("status",)).withColumn("total", F.col("total").cast("decimal(38,6)"))


@query("""WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT key, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY key, s""")
def activity_sessions(s: S, d: str) -> DataFrame:
    return feeds.sessions(log(s, d), "key")


@query("SELECT user_id % 50 AS deal_id, count(*) AS documents FROM events GROUP BY 1 HAVING count(*) FILTER (value < 0) = 0")
def completion_barrier(s: S, d: str) -> DataFrame:
    rows = read(s, d, "events").select((F.col("user_id") % 50).alias("deal_id"), F.when(F.col("value") < 0, "queued").otherwise("parsed").alias("status"))
    return feeds.complete(rows)


def streamed(s: S, d: str, plan, mode: str = "append") -> DataFrame:
    """What a stream over the event files writes until it has caught up."""
    schema = read(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    at = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    plan(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out")


@query("SELECT * FROM (SELECT event_type AS status, time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DECIMAL(38,6)) AS total, count(*) AS n FROM events GROUP BY ALL) q WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_inflow_tumbling(s: S, d: str) -> DataFrame:
    """Windows that the watermark has closed: later ones wait for more events."""
    named = lambda e: e.select(F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("decimal(24,6)").alias("value"))
    out = streamed(s, d, lambda e: feeds.tumbling(named(e), "value", keys=("status",), late="1 day"))
    return out.select("status", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("total").cast("decimal(38,6)").alias("total"), "n")


@query("SELECT count(*) AS changes FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) q WHERE was IS DISTINCT FROM event_type")
def stream_status_feed(s: S, d: str) -> DataFrame:
    out = streamed(s, d, lambda e: feeds.status_feed(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))))
    return out.agg(F.count(F.lit(1)).alias("changes"))


def deal_log(events: DataFrame) -> DataFrame:
    """Events as a log of documents (users) of deals: (deal, document, status, at)."""
    return events.select((F.col("user_id") % 50).alias("deal"), F.col("user_id").alias("document"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))


def run_once(s: S, d: str, plan) -> DataFrame:
    """What a stream with state over the event files writes until it has caught up, each batch once."""
    own = stateful.session(s)
    stream = own.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    at = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    plan(stream).writeStream.foreachBatch(stateful.exactly_once(at)).option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stateful.written(s, at).drop("batch")


LOG = "l AS (SELECT user_id % 50 AS deal, user_id AS document, event_type AS status, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events)"


@query(f"""WITH {LOG}, ch AS (SELECT * FROM l WHERE was IS DISTINCT FROM status AND epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)),
i AS (SELECT *, sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) OVER w AS documents, sum(CASE WHEN status = 'purchase' THEN 1 WHEN was = 'purchase' THEN -1 ELSE 0 END) OVER w AS done FROM ch WINDOW w AS (PARTITION BY deal ORDER BY ts, document))
SELECT deal, 'document' AS kind, document, status, epoch_us(ts) AS at_us, NULL::BIGINT AS documents, NULL::BIGINT AS done FROM ch
UNION ALL SELECT deal, 'index', NULL, NULL, epoch_us(ts), CAST(documents AS BIGINT), CAST(done AS BIGINT) FROM i WHERE was IS NULL OR status = 'purchase' OR was = 'purchase'""")
def stream_deal_feed(s: S, d: str) -> DataFrame:
    """Status changes of documents and of their deal's index, all rows that the watermark has passed, by a stream with timers."""
    return run_once(s, d, lambda e: stateful.status_feed(deal_log(e), "purchase"))


@query(f"""WITH {LOG}, x AS (SELECT deal, document, ts, status IN ('purchase', 'error') AS ended, sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) OVER w AS documents,
  sum(CASE WHEN status NOT IN ('purchase', 'error') THEN 1 ELSE 0 END - CASE WHEN was IS NOT NULL AND was NOT IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER w AS waiting FROM l WINDOW w AS (PARTITION BY deal ORDER BY ts, document))
SELECT DISTINCT deal, CAST(documents AS BIGINT) AS documents, 'index:' || deal || ':' || CAST(documents AS BIGINT) AS idempotency_key FROM x WHERE ended AND waiting = 0""")
def stream_barrier(s: S, d: str) -> DataFrame:
    """When all documents of a deal have come to an end, once for each number of documents, by a stream with state."""
    return run_once(s, d, lambda e: stateful.barrier(deal_log(e), ("purchase", "error")))
