"""Tasks as a stream: states, expiry and tombstones in keyed state with timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.tasks import DEFAULT_TTL_MS, LEAST_TTL_MS, MOST_TTL_MS, TERMINAL

OUTPUT = "task_id string, owner_key string, status string, created_ms long, updated_ms long, expired boolean"
#: Of a bucket of tasks, as JSON: the events of each living task, the deadline of each expired one.
STATE = "live string, gone string"
BUCKETS = 512
#: The store that keeps state on disk, as one of many tasks needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ttl(value: object) -> int:
    return DEFAULT_TTL_MS if value is None or value != value else min(max(int(value), LEAST_TTL_MS), MOST_TTL_MS)


def lifecycle(events: list[tuple]) -> tuple[str | None, str, int, int, int]:
    """(owner_key, status, created_ms, updated_ms, deadline_ms) of a task's events (ms, status, owner_key, ttl_ms), in any order.

    The first event names the owner and the time to live; events after the deadline come too late; the first terminal
    status is final. Of events of one time the one with the smallest status comes first.
    """
    ordered = sorted(events, key=lambda e: (e[0], e[1]))
    created, _, owner, ttl = ordered[0]
    deadline = created + _ttl(ttl)
    alive = [e for e in ordered if e[0] <= deadline]
    ms, status, *_ = next((e for e in alive if e[1] in TERMINAL), alive[-1])
    return owner, status, created, ms, deadline


def _advanced(live: dict, gone: dict, news: dict, watermark: int, keep_ms: int) -> tuple[list[tuple], int | None]:
    """Rows of the tasks in ``news`` and of those that have expired by ``watermark``, and when a task or tombstone is due next.

    ``live`` (events by task) and ``gone`` (deadlines of expired tasks) are brought up to date.
    """
    news = {t: e for t, e in news.items() if t not in gone}  # what comes for an expired task comes too late
    for task, events in news.items():
        live[task] = live.get(task, set()) | events
    found = {t: lifecycle(list(e)) for t, e in live.items()}
    rows = [(t, *found[t][:4], False) for t in news]
    for task, x in found.items():
        if x[4] < watermark:
            del live[task]
            gone[task] = x[4]
            rows.append((task, *x[:4], True))
    for task in [t for t, deadline in gone.items() if deadline + keep_ms + 1 < watermark]:
        del gone[task]
    return rows, min([*(found[t][4] for t in live), *(deadline + keep_ms + 1 for deadline in gone.values())], default=None)


def task_stream(events: DataFrame, delay: str = "1 day", keep_ms: int = MOST_TTL_MS, buckets: int = BUCKETS) -> DataFrame:
    """The tasks of a stream of events (task_id, owner_key, ts, status, ttl_ms): a row whenever a task changes, and one with ``expired`` once its age passes its time to live.

    Repeated events count once, events out of order within ``delay`` as if in order. A task's events are kept while it
    lives, its tombstone for ``keep_ms`` after it has expired, then nothing. Session state has to be kept by ``PROVIDER``.
    The last row of a task is its state. State is keyed by ``buckets`` of tasks, so calls and timers of a micro-batch are
    bounded by their number, not by that of tasks; a checkpoint keeps the number it began with.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(F.col("task_id").cast("string").alias("task_id"), "owner_key", "status", F.col("ttl_ms").cast("long").alias("ttl_ms"), F.unix_millis("ts").alias("ms"), "ts")
    fields = [f.split()[0] for f in OUTPUT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept = [json.loads(x) for x in held.get] if held.exists else [[], []]
        live, gone = {t: {tuple(e) for e in found} for t, found in kept[0]}, dict(kept[1])
        news: dict[str | None, set[tuple]] = {}
        if not held.hasTimedOut:
            for batch in batches:
                ttls = [None if t is None or t != t else int(t) for t in batch["ttl_ms"].tolist()]
                for task, *event in zip(batch["task_id"].tolist(), batch["ms"].tolist(), batch["status"].tolist(), batch["owner_key"].tolist(), ttls):
                    news.setdefault(task, set()).add(tuple(event))
        watermark = held.getCurrentWatermarkMs()
        rows, due = _advanced(live, gone, news, watermark, keep_ms)
        if due is not None:
            held.update((json.dumps([[t, list(e)] for t, e in live.items()]), json.dumps(list(gone.items()))))
            held.setTimeoutTimestamp(max(due, watermark))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(rows, columns=fields)

    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """Each task's last row of an output with ``batch`` numbers; an expiry comes after what else its batch says."""
    last = F.max_by(F.struct("owner_key", "status", "created_ms", "updated_ms", "expired"), F.struct("batch", "expired")).alias("x")
    return rows.groupBy("task_id").agg(last).select("task_id", "x.*")
