"""Metrics of real runs: stage durations out of the page operator, fetches, and what a job or a stream observes on its way.

Everything here reads what the operators measured where they ran; nothing is run again to be timed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from weftline.functions.urls import redact_url
from weftline.operators.pages import STAGES

# The budget of a page in milliseconds, the share of it above which a stage is slow, and a slow fetch.
BUDGET_MS, WARN_SHARE, SLOW_FETCH_MS = 30_000, 0.5, 5_000


def stage_runs(results: DataFrame, budget_ms: float = BUDGET_MS, warn_share: float = WARN_SHARE) -> DataFrame:
    """(page_id, partition, stage, url without secrets, duration_ms, slow) for each stage that a page of ``transform_pages(..., timed=True)`` ran through."""
    rows = results.select("page_id", "partition", redact_url(F.col("url")).alias("url"), F.explode("stages").alias("s"))
    return rows.select("page_id", "partition", "s.stage", "url", "s.duration_ms", (F.col("s.duration_ms") > budget_ms * warn_share).alias("slow"))


def stage_summary(results: DataFrame, budget_ms: float = BUDGET_MS, warn_share: float = WARN_SHARE) -> DataFrame:
    """One row for each stage and partition: pages, total_ms, max_ms, n_slow and slow (whether any page's was)."""
    runs = stage_runs(results, budget_ms, warn_share).groupBy("stage", "partition")
    n_slow = F.count_if("slow")
    return runs.agg(F.count(F.lit(1)).alias("pages"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), n_slow.alias("n_slow"), (n_slow > 0).alias("slow"))


def fetch_runs(rows: DataFrame, slow_ms: float = SLOW_FETCH_MS) -> DataFrame:
    """(url without secrets, event, status, error, duration_ms, slow) of rows of ``sources/web.py``: event is ``end``, or ``error`` where no answer came or one of status 400 and more."""
    event = F.when(F.col("error").isNotNull() | (F.col("status") >= 400), F.lit("error")).otherwise(F.lit("end"))
    return rows.select(redact_url(F.col("url")).alias("url"), event.alias("event"), "status", "error", "duration_ms", (F.col("duration_ms") > slow_ms).alias("slow"))


def _spent(stage: str) -> Column:
    laps = F.filter("stages", lambda s: s["stage"] == stage)
    return F.aggregate(laps, F.lit(0.0), lambda a, s: a + s["duration_ms"])


def observed(results: DataFrame, observation: Observation | str, budget_ms: float = BUDGET_MS, warn_share: float = WARN_SHARE) -> DataFrame:
    """``results`` unchanged, counted while whatever action comes passes over them: pages, failed, slow, and milliseconds by stage.

    An ``Observation`` holds the figures of a batch job; a name sends those of a stream's micro-batches to listeners.
    """
    slow = F.exists("stages", lambda s: s["duration_ms"] > budget_ms * warn_share)
    counts = [F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(slow).alias("slow")]
    return results.observe(observation, *counts, *[F.sum(_spent(s)).alias(f"{s}_ms") for s in STAGES])


class StageListener(StreamingQueryListener):
    """Gives ``report`` one row (a dict) for each micro-batch in which the figures named ``name`` were observed.

    ``spark.streams.addListener(StageListener("pages", rows.append))``; ``batch`` and ``run`` say which micro-batch it was.
    """

    def __init__(self, name: str, report: Callable[[dict], None]) -> None:
        self.name, self.report = name, report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.report({"run": str(event.progress.runId), "batch": event.progress.batchId, **found.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
