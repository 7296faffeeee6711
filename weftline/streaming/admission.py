"""Session capacity of a tenant: reservations in flight, the oldest session giving way, idle ones expiring; as a table and as a stream."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPS = ("reserve", "open", "touch", "close")
OUTPUT = "tenant string, seq long, outcome string, evicted string"
#: Fixed value: idle sessions end after half an hour.
IDLE_MS = 1_800_000


class Sessions:
    """A tenant's sessions by last use, oldest first, and how many reservations are in flight. At most ``most`` are admitted."""

    def __init__(self, most: int, idle_ms: int, held: Iterable[tuple[str, int]] = (), in_flight: int = 0):
        self.most, self.idle_ms, self.held, self.in_flight = most, idle_ms, OrderedDict(held), in_flight

    def step(self, ms: int, op: str, session: str) -> tuple[str, str | None]:
        """(outcome, evicted session) of a request: a reservation is admitted or refused; a session is opened, touched, closed or unknown."""
        while self.held and ms - next(iter(self.held.values())) > self.idle_ms:
            self.held.popitem(last=False)
        if op == "reserve":
            evicted, size = None, len(self.held)
            if size + self.in_flight >= self.most:
                if not (self.most > 0 and size >= self.most > size - 1 + self.in_flight):
                    return "refused", None
                evicted = self.held.popitem(last=False)[0]
            self.in_flight += 1
            return "admitted", evicted
        if op == "open":
            self.in_flight = max(0, self.in_flight - 1)
        elif session not in self.held:
            return "unknown", None
        if op == "close":
            del self.held[session]
            return "closed", None
        self.held[session] = ms
        self.held.move_to_end(session)
        return ("opened" if op == "open" else "touched"), None


def admit(requests: DataFrame, most: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """(tenant, seq, outcome, evicted) of ``requests`` (tenant, seq, ms, op, session_id), op one of OPS, in the order of ms and seq.

    Tenants are independent: each streams through one ordered fold in Arrow batches, whose state is its sessions and one
    number. A null session_id counts as empty; rows of a null tenant are one tenant. Requests of another op are an error.
    """
    tenant = F.col("tenant").cast("string").alias("tenant")
    rows = requests.select(tenant, F.col("seq").cast("long").alias("seq"), F.col("ms").cast("long").alias("ms"), "op", F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session_id"))
    known = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("not an operation: "), F.coalesce("op", F.lit("null")))))
    dealt = rows.withColumn("op", known).repartition("tenant").sortWithinPartitions("tenant", "ms", "seq")

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sessions = object(), Sessions(most, idle_ms)
        for batch in stream:
            out = []
            for t, seq, ms, op, session in zip(*(batch[c].tolist() for c in ("tenant", "seq", "ms", "op", "session_id"))):
                if t != at:
                    at, sessions = t, Sessions(most, idle_ms)
                out.append((t, seq, *sessions.step(ms, op, session)))
            yield pd.DataFrame(out, columns=["tenant", "seq", "outcome", "evicted"])

    return dealt.mapInPandas(run, OUTPUT)


class AdmissionProcessor(StatefulProcessor):
    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "session_id string, ms long")
        self.in_flight = handle.getValueState("in_flight", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        sessions = Sessions(self.most, self.idle_ms, held, self.in_flight.get()[0] if self.in_flight.exists() else 0)
        requests = pd.concat(list(rows)).sort_values(["ms", "seq"])
        out = [(key[0], seq, *sessions.step(ms, op, session)) for seq, ms, op, session in zip(*(requests[c].tolist() for c in ("seq", "ms", "op", "session_id")))]
        if sessions.held:
            self.held.put(list(sessions.held.items()))
        else:
            self.held.clear()
        self.in_flight.update((sessions.in_flight,))
        yield pd.DataFrame(out, columns=["tenant", "seq", "outcome", "evicted"])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, most: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """``admit`` of a stream: a micro-batch's requests go in the order of ms and seq, after those of earlier micro-batches. The session's state store has to be ``lifecycle.PROVIDER``."""
    rows = requests.select(F.col("tenant").cast("string").alias("tenant"), F.col("seq").cast("long").alias("seq"), F.col("ms").cast("long").alias("ms"), "op", F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session_id"))
    return rows.groupBy("tenant").transformWithStateInPandas(AdmissionProcessor(most, idle_ms), OUTPUT, "Append", "None")
