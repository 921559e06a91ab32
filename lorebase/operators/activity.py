"""Signals, gates, conversations, memory, caches and queues on event tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def haloed(rows: DataFrame, seconds: int) -> DataFrame:
    """``rows(ts, ...)`` with _sec, dealt to spans of time (_span): each row in its own, and as halo (not _own) in the next.

    A window of up to ``seconds`` before a row then lies within the row's span, so that one key's rows are
    spread over as many tasks as it has spans.
    """
    sec = F.col("ts").cast("timestamp").cast("long")
    spans = F.array(F.struct(F.lit(0).alias("d"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("d"), F.lit(False).alias("own")))
    out = rows.withColumn("_sec", sec).withColumn("_p", F.explode(spans))
    return out.withColumn("_span", F.floor(F.col("_sec") / seconds) + F.col("_p.d")).withColumn("_own", F.col("_p.own")).drop("_p")


def repeat_signals(searches: DataFrame, least: int = 3, minutes: int = 30) -> DataFrame:
    """A signal for the third and every further search with the same key within the window before it.

    ``searches(study, key, id, ts)`` -> (study, key, id, cnt, severity).
    """
    near = Window.partitionBy("study", "key", "_span").orderBy("_sec").rangeBetween(-60 * minutes, 0)
    rows = haloed(searches.select("study", "key", "id", "ts"), 60 * minutes)
    out = rows.withColumn("cnt", F.count("*").over(near)).where(F.col("_own") & (F.col("cnt") >= least))
    return out.select("study", "key", "id", "cnt", F.least(F.lit(1.0), F.col("cnt") / 10).alias("severity"))


def alerts(signals: DataFrame, minutes: int = 5) -> DataFrame:
    """Undismissed signals with two or more types in the window before them: (study, id, ts, combo, n_types)."""
    near = Window.partitionBy("study", "_span").orderBy("_sec").rangeBetween(-60 * minutes, 0)
    types = F.array_sort(F.collect_set("type").over(near))
    rows = haloed(signals.where("not dismissed").select("study", "id", "ts", "type"), 60 * minutes)
    out = rows.withColumn("types", types).where(F.col("_own") & (F.size("types") >= 2))
    return out.select("study", "id", "ts", F.array_join("types", "+").alias("combo"), F.size("types").alias("n_types"))


def cooldown(events: DataFrame, seconds: int = 300) -> DataFrame:
    """The rows of ``events(key, id, ts, ...)`` that pass: the first of a key, and those ``seconds`` after the last that passed.

    Each key's rows stream through one task in order of time, and its state is one time; no key's
    history is gathered.
    """
    names = events.columns

    def run(it):
        key, last, empty = None, None, True
        for batch in it:
            keys, times, kept = batch.column("key").to_pylist(), batch.column("_at").to_pylist(), []
            for at, (k, t) in enumerate(zip(keys, times, strict=True)):
                if empty or k != key or t >= last + 1_000_000 * seconds:
                    key, last, empty = k, t, False
                    kept.append(at)
            yield batch.take(pa.array(kept, pa.int64())).select(names)

    rows = events.where("ts is not null").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.repartition("key").sortWithinPartitions("key", "_at", "id")
    return rows.mapInArrow(run, events.schema)


def cooled_alerts(alerts: DataFrame, minutes: int = 30) -> DataFrame:
    """``alerts(study, id, ts, combo, ...)`` without those of a combination that fired in the study ``minutes`` before."""
    return cooldown(alerts.withColumn("key", F.to_json(F.struct("study", "combo"))), 60 * minutes).drop("key")


def alert_facts(alerts: DataFrame, message: Column, types: int = 5) -> DataFrame:
    """(study, id, ts, kind, content, confidence): the memory fact of each alert that fired; confidence is the share of signal types."""
    return alerts.select("study", "id", "ts", F.lit("meta").alias("kind"), message.alias("content"), F.round(F.col("n_types") / types, 6).alias("confidence"))


def metacog_signals(turns: DataFrame) -> DataFrame:
    """(study, id, ts, type, severity, dismissed) of ``turns(study, id, ts, text, citation, progress)``: what each turn tells of misjudged ability."""
    gap, said = T.progress_gap_severity(F.col("citation"), F.col("progress"), 9), T.self_report_severity(F.col("text"), F.col("citation"))
    found = F.array(F.struct(F.lit("progress_recall_gap").alias("type"), gap.alias("severity")), F.struct(F.lit("self_report_low").alias("type"), said.alias("severity")))
    rows = turns.select("study", "id", "ts", F.inline(found))
    return rows.where("severity is not null").withColumn("dismissed", F.lit(False))


def latency(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, delta): each user message that an assistant's follows directly, with the turns between."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = messages.withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("turn").over(w))
    return pairs.where("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.greatest(F.lit(0), F.col("t2") - F.col("turn")).alias("delta"))


def followup_reuse(messages: DataFrame, sourced: Column, followup: Column) -> DataFrame:
    """(conv_id, users, followups, reusable): follow-up questions after an answer that had sources."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("role") == "assistant", sourced), ignorenulls=True).over(before), F.lit(False))
    rows = messages.withColumn("had", last).withColumn("f", followup).where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.count("*").alias("users"), F.count_if("f").alias("followups"), F.count_if(F.col("f") & F.col("had")).alias("reusable"))


def recent(messages: DataFrame, n: int, asked: DataFrame | None = None) -> DataFrame:
    """The last n messages of each conversation, with their place from the end; those equal to ``asked(conv_id, question)`` are left out."""
    if asked is not None:
        messages = messages.join(asked, "conv_id", "left").where("question is null or text <> question").drop("question")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def split_history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """(conv_id, raw, older): up to ``turns`` messages all stay raw; of more, the last 2 * ``turns``, and the older ones as one text to summarise."""
    w = Window.partitionBy("conv_id")
    rows = messages.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("n", F.count("*").over(w))
    keep = (F.col("n") <= turns) | (F.col("back") <= 2 * turns)
    out = rows.groupBy("conv_id").agg(F.count_if(keep).alias("raw"), F.array_sort(F.collect_list(F.when(~keep, F.struct("turn", "text")))).alias("o"))
    return out.select("conv_id", "raw", F.array_join("o.text", " ").alias("older"))


def gates(facts: DataFrame, cards: DataFrame, attempts: DataFrame, ratings: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row of learning gates, with the mean citation score of the last ``messages`` if given; a ratio of nothing is null. The one-row aggregates are joined on a constant."""
    one = F.lit(1).alias("one")
    ratio = lambda good: F.round(F.try_divide(F.count_if(good), F.count("*")), 6)
    out = facts.agg(ratio(F.col("status") == "active").alias("active_ratio")).select("*", one)
    out = out.join(cards.where("method not in ('manual', 'legacy')").agg(ratio(F.col("citation") >= 0.5).alias("card_ratio")).select("*", one), "one")
    out = out.join(attempts.agg(F.count_if(F.col("outcome") == "dismissed").alias("dismissed"), ratio(F.col("outcome").isin("correct", "incorrect")).alias("attempted_ratio")).select("*", one), "one")
    last = ratings.orderBy(F.desc("ts"), F.desc("id")).limit(10).agg(F.round(F.avg("rating"), 6).alias("rating_mean"))
    out = out.join(last.select("*", one), "one")
    if messages is not None:
        out = out.join(citation_accuracy(messages, 50).select(F.col("avg_score").alias("citation_mean"), one), "one")
    return out.drop("one")


def citation_accuracy(messages: DataFrame, last: int = 200) -> DataFrame:
    """One row over the last messages with citation scores in their JSON context; malformed contexts are skipped."""
    schema = "citation_scores array<struct<source_idx:int,score:double,verdict:string>>"
    rows = messages.orderBy(F.desc("id")).limit(last).select("id", F.from_json("context_json", schema).alias("c"))
    rows = rows.where(F.size("c.citation_scores") > 0).select("id", F.explode("c.citation_scores").alias("s"))
    count = lambda v: F.count_if(F.col("s.verdict") == v)
    return rows.agg(F.countDistinct("id").alias("messages"), F.count("*").alias("markers"), count("pass").alias("passes"), count("low").alias("lows"), count("no_match").alias("no_matches"), F.round(F.try_divide(count("pass"), F.count("*")), 6).alias("pass_ratio"), F.round(F.avg("s.score"), 6).alias("avg_score"))


def memory_levels(facts: DataFrame, first: int = 2000, second: int = 4000) -> DataFrame:
    """(study, l1, l2): active facts with confidence 0.5 or more as bullet lists, cut at ``first`` and ``second`` characters.

    A running sum of lengths leaves out, before anything is gathered, the facts that begin behind the cut.
    """
    rows = facts.where("status = 'active' and confidence >= 0.5").withColumn("level", F.when(F.col("kind").isin("preference", "correction"), "l1").otherwise("l2"))
    rows = rows.withColumn("most", F.when(F.col("level") == "l1", first).otherwise(second)).withColumn("line", F.concat(F.lit("- "), "content"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("study", "level").orderBy("kind", "created", "id").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.where("line is not null").withColumn("before", F.coalesce(before, F.lit(0))).where("before <= most")
    lists = kept.groupBy("study", "level").agg(F.array_sort(F.collect_list(F.struct("kind", "created", "id", "line"))).alias("f"))
    text = F.array_join("f.line", "\n")
    cut = F.when(F.col("level") == "l1", T.truncate_lines(text, first)).otherwise(T.truncate_lines(text, second))
    level = lambda k: F.coalesce(F.max(F.when(F.col("level") == k, F.col("t"))), F.lit("")).alias(k)
    return lists.select("study", "level", cut.alias("t")).groupBy("study").agg(level("l1"), level("l2"))


#: Items of one side that meet in a task, about.
MEET = 10_000


def _conflicting(it):
    """(study, a, b, pref_id, corr_id, tokens) in order, each part's corrections first -> (study, pref_id, corr_id, token)."""
    key, held, corrections, out, n_out = None, {}, [], [], 0

    def found(study, pref, rows):
        tokens = [t for _, t in sorted((k, t) for row in rows for k, t in enumerate(row)) if t in held]
        if tokens:
            lists = [held[t] for t in dict.fromkeys(tokens)]
            which, first = np.unique(np.concatenate(lists), return_index=True)  # of each correction the first token
            named = np.searchsorted(np.cumsum(list(map(len, lists))), first, "right")
            out.append((study, pref, which, named, list(dict.fromkeys(tokens))))
        return len(which) if tokens else 0

    def rows():
        size = [len(x[2]) for x in out]
        study, pref = (pa.array([x[c] for x in out], kinds[c]).take(pa.array(np.repeat(np.arange(len(out)), size))) for c in (0, 1))
        start = np.cumsum([0, *(len(x[4]) for x in out)])
        tokens = pa.array([t for x in out for t in x[4]], pa.string())
        corr = pa.array(corrections, kinds[2]).take(pa.array(np.concatenate([x[2] for x in out])))
        return pa.RecordBatch.from_arrays([study, pref, corr, tokens.take(pa.array(np.concatenate([x[3] + s for x, s in zip(out, start, strict=False)])))], names=["study", "pref_id", "corr_id", "token"])

    kinds, now, same = None, None, []
    for batch in it:
        kinds = [batch.schema.field(c).type for c in (0, 3, 4)]
        for study, a, b, pref, corr, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and (study, a, b, pref) != now:
                n_out += found(now[0], now[3], same)
                now, same = None, []
            if (study, a, b) != key:
                if out:
                    yield rows()
                key, held, corrections, out, n_out = (study, a, b), {}, [], [], 0
            if pref is None:
                if not corrections or corrections[-1] != corr:
                    corrections.append(corr)
                for t in tokens:
                    if not (own := held.setdefault(t, [])) or own[-1] != len(corrections) - 1:
                        own.append(len(corrections) - 1)
                continue
            now = (study, a, b, pref)
            same.append(tokens)
            if n_out > 100_000:
                yield rows()
                out, n_out = [], 0
    if now is not None:
        found(now[0], now[3], same)
    if out:
        yield rows()


def conflicts(preferences: DataFrame, corrections: DataFrame) -> DataFrame:
    """(study, pref_id, corr_id, token): items that share a significant token, the first in the preference's order.

    A study's preferences and corrections are dealt to a grid of parts and meet there, through the tokens that a
    part's corrections have. All that travels is each item once a row or column of the grid; the pairs, which can
    be as many as the product of both sides, are made where they are returned.
    """
    p = preferences.select("study", F.col("id").alias("pref_id"), T.significant(F.col("text")).alias("tokens")).where("study is not null and pref_id is not null and size(tokens) > 0")
    c = corrections.select("study", F.col("id").alias("corr_id"), F.array_distinct(T.significant(F.col("text"))).alias("tokens")).where("study is not null and corr_id is not null and size(tokens) > 0")
    most = lambda df: df.groupBy("study").count().agg(F.max("count")).first()[0] or 1
    n_a, n_b = (-(-most(df) // MEET) for df in (p, c))
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((p, "study"), (p, "pref_id"), (c, "corr_id"))}
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = p.select("study", part("pref_id", n_a).alias("a"), every(n_b).alias("b"), "pref_id", F.lit(None).cast(kinds["corr_id"]).alias("corr_id"), "tokens")
    right = c.select("study", every(n_a).alias("a"), part("corr_id", n_b).alias("b"), F.lit(None).cast(kinds["pref_id"]).alias("pref_id"), "corr_id", "tokens")
    rows = left.unionByName(right).repartition("study", "a", "b").sortWithinPartitions("study", "a", "b", "pref_id", "corr_id")
    return rows.mapInArrow(_conflicting, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", token string")


def latest(rows: DataFrame, key: str, version: list[Column], n: int = 1) -> DataFrame:
    """The ``n`` rows of each key that come first by ``version``; one is an upsert. Each task keeps n rows a key before the exchange."""
    w = Window.partitionBy(key).orderBy(*version)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def evict_lru(cache: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows used last (never used counts as oldest), ties by key."""
    return cache.orderBy(F.coalesce("last_hit", F.lit(0)).desc(), key).limit(most)


def retry_schedule(failures: DataFrame) -> DataFrame:
    """(study, job_type, payload, attempts, next_retry): back-off of 1, 2, 4 and 8 minutes after the last failure, then none."""
    rows = failures.groupBy("study", "job_type", "payload").agg(F.count("*").alias("attempts"), F.max("ts").alias("ts"))
    wait = F.when(F.col("attempts") == 1, 1).when(F.col("attempts") == 2, 2).when(F.col("attempts") == 3, 4).when(F.col("attempts") == 4, 8)
    return rows.select("study", "job_type", "payload", "attempts", (F.col("ts") + F.make_dt_interval(mins=wait)).alias("next_retry"))


def outcome_routes(attempts: DataFrame) -> dict[str, DataFrame]:
    """Recall outcomes: every attempt is kept; all but correct ones also make a signal and a correction fact."""
    missed = attempts.where("outcome <> 'correct'")
    return {
        "attempts": attempts,
        "signals": missed.select("study", F.lit("forced_output_miss").alias("type"), "id", "ts"),
        "facts": missed.select("study", F.lit("correction").alias("kind"), F.lit(0.7).alias("confidence"), F.substring("text", 1, 80).alias("content"), "id"),
    }


def embed_failures(chunks: DataFrame, most: int = 3) -> DataFrame:
    """Each failure adds an attempt; from ``most`` on the status is failed."""
    n = F.col("attempts") + 1
    return chunks.withColumn("status", F.when(n >= most, "failed").otherwise(F.col("status"))).withColumn("attempts", n)


def job_state(log: DataFrame) -> DataFrame:
    """The last status of each job in an append-only log, with its first start."""
    return log.groupBy("job").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started"), F.max("ts").alias("updated"))


def fresh(cache: DataFrame, keys: DataFrame, as_of: Column, ttl: str = "7 days") -> DataFrame:
    """Read-through: each key with its cached value if that isn't older than the time to live."""
    live = cache.where(F.col("created") >= as_of - F.expr(f"interval {ttl}"))
    return keys.join(live, "key", "left").withColumn("hit", F.col("created").isNotNull())


def cascade(parents_gone: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """Delete the rows of each child table whose reference is among ``parents_gone(key)``."""
    return {name: df.join(parents_gone.select(F.col(key).alias(ref)), ref, "left_anti") for name, (df, ref) in children.items()}


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """``df``, failing at run time on a value outside ``allowed``."""
    bad = F.raise_error(F.concat(F.lit(f"{column} must be one of {', '.join(allowed)}: "), F.col(column)))
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(bad))


def prefix_cache_ratio(usage: DataFrame) -> DataFrame:
    """One row: cached share of input tokens; rows without tokens are out, negatives count as 0."""
    read, new = F.greatest("cached", F.lit(0)), F.greatest("fresh", F.lit(0))
    rows = usage.where("cached > 0 or fresh > 0")
    return rows.agg(F.round(F.try_divide(F.sum(read), F.sum(read) + F.sum(new)), 6).alias("ratio"), F.count("*").alias("rows_used"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the right side's last ``value`` at or before its time: a union and one window, no range join."""
    both = left.withColumn("_s", F.lit(1)).unionByName(right.select(key, at, value).withColumn("_s", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last(F.when(F.col("_s") == 0, F.col(value)), ignorenulls=True).over(w))
    return filled.where("_s = 1").drop("_s")
