"""Streams give what the batch forms give, with rows out of order, late rows, expiring state and replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import activity as A
from lorebase.operators import indexing as I
from lorebase.streaming import jobs as J

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, study long, key string"
END = (9999, BASE + dt.timedelta(days=30), 99, "end")  # moves the watermark past all that counts


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def written(spark, folder, batches):
    """One file for each batch, to be read in that order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(*[f"{folder}/*"])


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in three files; within one, and across two, neighbours up to five minutes apart are swapped."""
    rng = random.Random(1)
    rows, second = [], 0
    for i in range(300):
        second += rng.randrange(1, 400)
        rows.append((i, at(second), rng.randrange(3), rng.choice("abc")))
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(300)))
    folder = str(tmp_path_factory.mktemp("events"))
    stream = written(spark, folder, [shuffled[:100], shuffled[100:200], shuffled[200:], [END]])
    return spark.createDataFrame(rows, SCHEMA), stream


def run(stream, name, tmp_path, mode="append"):
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    run.kept = sum(s["numRowsTotal"] for s in (q.lastProgress or {"stateOperators": []})["stateOperators"])
    return spark.table(name)


def test_repeat_signals(spark, events, tmp_path):
    df, stream = events
    got = sorted(map(tuple, run(J.repeat_signals(stream), "repeats", tmp_path).select("study", "key", "id", "cnt").collect()))
    assert got and got == sorted(map(tuple, A.repeat_signals(df).select("study", "key", "id", "cnt").collect()))


def test_cooldown_and_expiry(spark, events, tmp_path):
    df, stream = events
    cooled = run(J.cooldown(stream.select(F.col("study").alias("key"), "id", "ts"), 900), "cooled", tmp_path)
    got = sorted(r.id for r in cooled.where("key < 99").collect())
    kept = run.kept
    batch = df.select(F.col("study").alias("key"), "id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    assert got and got == sorted(r.id for r in A.cooldown(batch, 900).collect())
    assert kept <= 4  # nothing is left of the three keys but, at most, the last event's own


def test_alerts_with_cooldown(spark, events, tmp_path):
    df, stream = events
    got = sorted((r.study, r.id, r.combo) for r in run(J.alerts(stream.withColumnRenamed("key", "type")), "alerts", tmp_path).collect())
    signals = df.select("study", F.col("key").alias("type"), "id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(False).alias("dismissed"))
    fired = A.cooled_alerts(A.alerts(signals), 30)
    assert got and got == sorted((r.study, r.id, r.combo) for r in fired.collect())


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    first = [(1, at(0), 1, "a"), (2, at(3600), 1, "a")]
    late = [(3, at(60), 1, "a"), (4, at(3500), 1, "a"), (5, at(3700), 1, "a")]
    stream = written(spark, str(tmp_path / "in"), [first, late, [END]])
    got = {r.id for r in run(J.cooldown(stream.select(F.col("study").alias("key"), "id", "ts"), 1), "late", tmp_path).collect()}
    assert {1, 2, 4, 5} <= got and 3 not in got


def test_tumbling_windows(spark, events, tmp_path):
    df, stream = events
    stream = stream.select("ts", F.col("key").alias("event_type"), F.lit(1.0).alias("value"))
    got = sorted(map(tuple, run(J.tumbling_counts(stream), "tumbling", tmp_path).select("start", "event_type", "n").collect()))
    want = df.groupBy(F.window("ts", "1 hour").start.alias("start"), "key").count()
    assert got == sorted(map(tuple, want.collect()))


def test_sessions_and_deduplication(spark, events, tmp_path):
    df, stream = events
    got = sorted(map(tuple, run(J.sessions(stream.withColumnRenamed("study", "user_id"), "10 minutes"), "sessions", tmp_path).where("user_id < 99").collect()))
    want = df.groupBy("study", F.session_window("ts", "10 minutes").alias("w")).count().select("study", "w.start", "count")
    assert got == sorted(map(tuple, want.collect()))
    rows = [(1, at(0), 1, "a"), (1, at(5), 1, "a"), (2, at(6), 1, "b")]
    twice = written(spark, str(tmp_path / "twice"), [rows, [(2, at(9), 1, "b"), (3, at(10), 1, "c")]])
    assert sorted(r.id for r in run(J.deduplicated(twice, "id"), "dedup", tmp_path).collect()) == [1, 2, 3]


def test_short_dwell_is_stateless(spark):
    df = spark.createDataFrame([(1, 4999, 200), (2, 5000, 200), (3, 10, 199), (4, None, 900)], "id long, dwell_ms long, chars long")
    assert [(r.id, r.severity) for r in J.short_dwell(df).collect()] == [(1, 0.5)]


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [(i % 7, at(i), 1, "a") for i in range(20)]
    stream = written(spark, source, [rows, [(100, at(99), 1, "b")]])
    J.commit_batches(stream, out, str(tmp_path / "ck"), "id").awaitTermination(120)
    want = sorted(r.id for r in spark.read.parquet(out).collect())
    assert want == [0, 1, 2, 3, 4, 5, 6, 100]
    J.commit_batches(stream, out, str(tmp_path / "other"), "id").awaitTermination(120)  # as after a loss of the checkpoint
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == want


def test_read_through_cache(spark, events, tmp_path):
    """The cache as keyed state gives what the batch form gives: hits refresh, what isn't used for the time to live is made anew."""
    df, stream = events
    log = lambda x: x.select(F.concat("key", F.col("study").cast("string")).alias("key"), "id", "ts", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows = run(J.read_through(log(stream), lambda: lambda t: f"<{t}>", 1200), "cached", tmp_path)
    got = sorted((r.key, r.id, r.hit, r.value) for r in rows.collect() if r.id != END[0])
    want = I.read_through(log(df), lambda t: F.concat(F.lit("<"), t, F.lit(">")), 1200)
    assert got == sorted((r.key, r.id, r.hit, r.value) for r in want.collect())
    hits = [x[2] for x in got]
    assert any(hits) and hits.count(False) > 9  # more misses than keys: some have expired
    assert run.kept <= 2  # nothing but the closing row's state is left
