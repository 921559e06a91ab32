"""Structured Streaming forms of the signals: event time, watermarks, and state that expires.

Event time is the ``ts`` column; the watermark allows WATERMARK of lateness, and later rows are dropped.
The keyed processors hold rows until the watermark has passed them and then fold them in order of time,
so rows that arrive late but within the watermark count as if they had come in order. A key's state goes
by a timer once it can't matter any more. Each job takes a streaming DataFrame and gives one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, a bounded number a trigger."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by event-time window."""
    out = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(user_id, start, n): each user's runs of events without a pause of ``gap``."""
    out = events.withWatermark("ts", WATERMARK).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark; its state goes with the watermark."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def short_dwell(events: DataFrame, most_ms: int = 5000, least_chars: int = 200) -> DataFrame:
    """Stateless, for streams and tables alike: short stays on long content."""
    return events.where((F.col("dwell_ms") < most_ms) & (F.col("chars") >= least_chars)).withColumn("severity", F.lit(0.5))


class _Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark passes them, folds them in order, and forgets by timer.

    ``memory`` is what a fold keeps: (time in microseconds, tag). An entry is dropped once the watermark
    is ``span`` seconds past it.
    """

    columns: list[str]
    span: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, tag string")
        self.memory = handle.getListState("memory", "at long, tag string")

    def fold(self, key, rows: list[tuple[int, int, str]], memory: list[tuple[int, str]]) -> tuple[list[tuple], list[tuple[int, str]]]:
        """Results for ``rows`` in order, and the memory after them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            at = pdf.ts.astype("datetime64[us]").astype("int64")
            tags = pdf["tag"] if "tag" in pdf else [""] * len(pdf)
            new = [(int(t), int(i), str(k)) for t, i, k in zip(at, pdf.id, tags, strict=True) if t >= passed]
            if new:
                self.waiting.appendList(new)
                first = min([t for t, _, _ in new] + [first] * (first is not None))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        out, memory = self.fold(key, due, [tuple(m) for m in self.memory.get()])
        memory = [m for m in memory if m[0] + self.span * 1_000_000 >= now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.memory.put(memory) if memory else self.memory.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if memory:
            self.handle.registerTimer(max(m[0] for m in memory) // 1000 + self.span * 1000 + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Repeat(_Ordered):
    """The times of a key's searches within the window; the third and each further one signals."""

    columns = ["study", "key", "id", "cnt", "severity"]

    def __init__(self, least: int, seconds: int):
        self.least, self.span = least, seconds

    def fold(self, key, rows, memory):
        out, at = [], [m[0] for m in memory]
        for k, (t, i, _) in enumerate(rows):
            second = t // 1_000_000
            at = [x for x in at if x // 1_000_000 >= second - self.span] + [t]
            more = sum(1 for x, _, _ in rows[k + 1 :] if x // 1_000_000 == second)  # searches of one second count for each other
            if len(at) + more >= self.least:
                out.append((key[0], key[1], i, len(at) + more, min(1.0, (len(at) + more) / 10)))
        return out, [(t, "") for t in at]


def repeat_signals(searches: DataFrame, least: int = 3, minutes: int = 30) -> DataFrame:
    """Streaming counterpart of the repeated-search signal for ``searches(study, key, id, ts)``."""
    return searches.withWatermark("ts", WATERMARK).groupBy("study", "key").transformWithStateInPandas(_Repeat(least, 60 * minutes), "study long, key string, id long, cnt long, severity double", "Append", "EventTime")


class _Cooldown(_Ordered):
    """The time of the last event that passed."""

    columns = ["key", "id", "ts"]

    def __init__(self, seconds: int):
        self.span = seconds

    def fold(self, key, rows, memory):
        out, last = [], max((m[0] for m in memory), default=None)
        for t, i, _ in rows:
            if last is None or t >= last + self.span * 1_000_000:
                last = t
                out.append((key[0], i, pd.Timestamp(t, unit="us")))
        return out, [(last, "")] if last is not None else []


def cooldown(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Streaming counterpart of the keyed cooldown for ``events(key, id, ts)``."""
    return events.withWatermark("ts", WATERMARK).groupBy("key").transformWithStateInPandas(_Cooldown(seconds), "key long, id long, ts timestamp", "Append", "EventTime")


class _Alerts(_Ordered):
    """Recent signals of a study; two or more types make an alert, the same combination once a cooldown."""

    columns = ["study", "id", "ts", "combo"]

    def __init__(self, seconds: int, quiet: int):
        self.seconds, self.quiet, self.span = seconds, quiet, max(seconds, quiet)

    def fold(self, key, rows, memory):
        out, recent, fired = [], [(t, k[1:]) for t, k in memory if k[0] == "s"], {k[1:]: t for t, k in memory if k[0] == "f"}
        for n, (t, i, kind) in enumerate(rows):
            second = t // 1_000_000
            recent = [(a, k) for a, k in recent if a // 1_000_000 >= second - self.seconds] + [(t, kind)]
            types = {k for _, k in recent} | {k for a, _, k in rows[n + 1 :] if a // 1_000_000 == second}
            if len(types) >= 2:
                combo = "+".join(sorted(types))
                if combo not in fired or t >= fired[combo] + self.quiet * 1_000_000:
                    fired[combo] = t
                    out.append((key[0], i, pd.Timestamp(t, unit="us"), combo))
        return out, [(t, f"s{k}") for t, k in recent] + [(t, f"f{k}") for k, t in fired.items()]


def alerts(signals: DataFrame, minutes: int = 5, quiet_minutes: int = 30) -> DataFrame:
    """Alerts with cooldown for ``signals(study, id, ts, type)``."""
    rows = signals.withColumn("tag", F.col("type")).withWatermark("ts", WATERMARK)
    return rows.groupBy("study").transformWithStateInPandas(_Alerts(60 * minutes, 60 * quiet_minutes), "study long, id long, ts timestamp, combo string", "Append", "EventTime")


class _ReadThrough(_Ordered):
    """A key's cached value, with the time it was last used; it lives ``seconds`` from then on."""

    columns = ["key", "id", "ts", "hit", "value"]

    def __init__(self, make: Callable[[], Callable[[str], str]], seconds: int):
        self.make, self.span, self.model = make, seconds, None

    def fold(self, key, rows, memory):
        out, (last, value) = [], max(memory, default=(None, None))
        for t, i, text in rows:
            hit = last is not None and t - last <= self.span * 1_000_000
            if not hit:
                self.model = self.model or self.make()
                value = self.model(text)
            last = t
            out.append((key[0], i, pd.Timestamp(t, unit="us"), hit, value))
        return out, [(last, value)] if last is not None else []


def read_through(lookups: DataFrame, make: Callable[[], Callable[[str], str]], seconds: int) -> DataFrame:
    """(key, id, ts, hit, value) of ``lookups(key, id, ts, text)``: a value used in the last ``seconds`` is a hit and is refreshed; a miss asks the model and puts its answer."""
    rows = lookups.withColumn("tag", F.col("text")).withWatermark("ts", WATERMARK)
    return rows.groupBy("key").transformWithStateInPandas(_ReadThrough(make, seconds), "key string, id long, ts timestamp, hit boolean, value string", "Append", "EventTime")


def commit_batches(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Idempotent sink: each micro-batch is one folder named by its id, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
