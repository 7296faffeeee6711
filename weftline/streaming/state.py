"""Keyed state over request events: anchored rate windows and idle sessions, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.cache import subscription_uri
from weftline.operators.quantiles import exact_quantiles
from weftline.streaming.run import write_once

LIMIT, WINDOW_MS, SESSION_GAP = 100, 60_000, "30 minutes"


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """``events`` with window_start, position and allowed.

    A key's window starts with its first event and lasts ``window_ms``; the first event after its end starts the next one.
    A key's events go through one ordered pandas fold in Arrow batches, so a hot key streams and is never held whole.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    dealt = events.withColumn("_ms", ms).repartition(F.col(key)).sortWithinPartitions(key, "_ms", *[c for c in events.columns if c.endswith("_id") and c != key])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, start, n = object(), 0, 0
        for batch in stream:
            starts, places = [], []
            for k, t in zip(batch[key].tolist(), batch["_ms"].tolist()):
                if k != held or t > start + window_ms:
                    held, start, n = k, t, 0
                n += 1
                starts.append(start)
                places.append(n)
            out = batch.drop(columns="_ms")
            yield out.assign(window_start_ms=starts, position=places, allowed=[p <= limit for p in places])

    return dealt.mapInPandas(run, ", ".join([*fields, "window_start_ms long", "position long", "allowed boolean"]))


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = SESSION_GAP) -> DataFrame:
    """(key, session_start, session_end, n_events): an event later than ``gap`` after the last one starts a new session."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(key, w).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end")).drop("session_window")


def session_recency(events: DataFrame, most: int = 200) -> DataFrame:
    """The most recently seen sessions, at most ``most``; the oldest give way."""
    seen = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.orderBy(F.desc("last_seen"), "user_id").limit(most)


STATE = "start_ms long, n long"
OUTPUT = "key string, window_start_ms long, position long, allowed boolean"


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, window_ms: int = WINDOW_MS, delay: str = "1 hour") -> DataFrame:
    """The rate windows of a stream (key, ts): state is two numbers for a key, dropped after two idle windows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        for batch in batches:
            times = sorted(int(t.timestamp() * 1000) for t in batch["ts"])
            rows = []
            for t in times:
                if start is None or t > start + window_ms:
                    start, n = t, 0
                n += 1
                rows.append((key[0], start, n, n <= limit))
            yield pd.DataFrame(rows, columns=["key", "window_start_ms", "position", "allowed"])
        state.update((start, n))
        state.setTimeoutTimestamp(max(start + 3 * window_ms, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(events: DataFrame, gap: str = SESSION_GAP, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))


def changed_subscriptions(changes: DataFrame, subscriptions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changed resources that someone subscribes to, by canonical address and ``by``, what tells resources of one address apart: a semi join, stream with table or table with table."""
    wanted = subscriptions.select(subscription_uri(F.col("uri")).alias("_uri"), *by).distinct()
    return changes.withColumn("_uri", subscription_uri(F.col("uri"))).join(wanted, ["_uri", *by], "left_semi").select(*changes.columns)


def change_feed(changes: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()) -> DataFrame:
    """The notifications of a stream of changes (uri, ...), written under ``path``: each change of a subscribed resource once, with its micro-batch's number.

    The subscriptions are a table, read anew for each micro-batch. A micro-batch that failed is written again in its own
    place, and a restart from ``checkpoint`` goes on after the last finished one, so nothing is notified twice or left out.
    """
    return write_once(changed_subscriptions(changes, subscriptions, by), path, checkpoint)


def duration_stats(rows: DataFrame, value: str) -> DataFrame:
    """Distribution of stage durations: moments by partial aggregates, exact percentiles by passes that count (``operators/quantiles.py``)."""
    x = F.col(value)
    shares = (0.5, 0.95, 0.99)
    found = exact_quantiles(rows, value, shares)
    out = rows.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"))
    return out.select("*", *[F.lit(q).cast("double").alias(f"p{round(100 * s)}") for q, s in zip(found, shares)])


def slow(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    return rows.filter(F.col(value) > threshold)


def lead_lag(lines: DataFrame) -> tuple[Column, Column]:
    """Previous line's blankness and whether content follows, over exploded lines (doc_id, line_no, line)."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    blank = F.trim("line") == ""
    return F.coalesce(F.lag(blank).over(w), F.lit(True)), F.coalesce(F.max(~blank).over(w.rowsBetween(1, 49)), F.lit(False))
