import datetime

from pyspark.sql import functions as F

from vaultlens.streaming import feeds

T = lambda s: datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=s)


def streamed(spark, rows, schema, path, plan, mode="append"):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in/*")
    plan(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def test_status_feed_emits_changes_alone(spark, tmp_path):
    schema = "key long, status string, at timestamp"
    parts = [[(1, "queued", T(0)), (1, "queued", T(1)), (2, "queued", T(1))], [(1, "parsed", T(2)), (2, "queued", T(3))]]
    got = streamed(spark, parts, schema, str(tmp_path), feeds.status_feed)
    assert sorted((r["key"], r["status"]) for r in got) == [(1, "parsed"), (1, "queued"), (2, "queued")]
    flat = spark.createDataFrame([r for p in parts for r in p], schema)
    assert feeds.status_changes(flat).count() == 3


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "at timestamp, value double"
    parts = [[(T(0), 1.0)], [(T(4 * 86400), 1.0)], [(T(10), 5.0)], [(T(8 * 86400), 1.0)]]
    got = streamed(spark, parts, schema, str(tmp_path), lambda s: feeds.tumbling(s, "value", late="1 day"))
    assert sorted(r["total"] for r in got)[0] in (1.0, 6.0) and len(got) >= 2


def test_retries_claims_and_keys(spark):
    log = spark.createDataFrame([(1, T(i)) for i in range(4)], "key long, at timestamp")
    assert [(r["state"], r["wait"]) for r in feeds.attempts(log).orderBy("at").collect()] == [("queued", 10), ("queued", 20), ("failed", None), ("late", None)]
    jobs = spark.createDataFrame([(1, "queued", T(0), None, T(5)), (2, "queued", T(9999), None, T(1)), (3, "running", T(0), T(0), T(2)), (4, "running", T(0), T(3500), T(3)), (5, "queued", T(0), None, T(1))], "job_id int, status string, run_after timestamp, locked_at timestamp, created_at timestamp")
    assert [r["job_id"] for r in feeds.claimed(jobs, "2025-01-01 01:00:00", 2).collect()] == [5, 3]
    keyed = spark.createDataFrame([("a", 2, T(1)), ("a", 1, T(0)), ("b", 3, T(0))], "idempotency_key string, n int, at timestamp")
    assert sorted((r["idempotency_key"], r["n"]) for r in feeds.idempotent(keyed).collect()) == [("a", 1), ("b", 3)]


def test_barrier_sessions_and_quarantine(spark):
    docs = spark.createDataFrame([(1, "parsed"), (1, "failed"), (2, "parsed"), (2, "queued")], "deal_id int, status string")
    assert [tuple(r) for r in feeds.complete(docs).collect()] == [(1, 2)]
    log = spark.createDataFrame([(1, T(0)), (1, T(1000)), (1, T(4000))], "key long, at timestamp")
    assert sorted(r["n"] for r in feeds.sessions(log, "key").collect()) == [1, 2]
    good, bad = feeds.quarantined(log.withColumn("error", F.when(F.col("at") > F.lit(T(500)), "e")))
    assert (good.count(), bad.count()) == (1, 2)
