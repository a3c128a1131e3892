"""Keyed state machines over event streams, with timers: leases that run out, changes on probation.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass) and, as
any stream, a checkpoint folder; after a restart they go on from their state.  Within
a micro-batch events are taken in order of their time; across batches as they come, and
what is older than the watermark is dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.streaming.dispatch import leases_batch

LEASE_EVENTS = "resource string, at double, owner string, event string"


class _Leases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, until double")

    def handleInputRows(self, key, rows, timerValues):
        requests = pd.concat(list(rows)).sort_values(["at", "owner"])
        owner, until = self.lease.get() if self.lease.exists() else (None, None)
        out = []
        for at, asks, ttl in requests[["at", "owner", "ttl"]].itertuples(index=False):
            if owner is not None and at >= until:
                out.append((until, owner, "released"))
                owner = None
            if owner in (None, asks):
                owner, until = asks, at + ttl
                out.append((at, asks, "granted"))
            else:
                out.append((at, asks, "refused"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.lease.update((owner, float(until)))
        self.handle.registerTimer(int(until * 1000))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        owner, until = self.lease.get()
        self.lease.clear()
        yield self._rows(key, [(until, owner, "released")])

    @staticmethod
    def _rows(key, out) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["resource", "at", "owner", "event"])

    def close(self) -> None:
        pass


def lease_stream(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of (resource, at, owner, ttl, ts) requests as (resource, at, owner, event): granted, refused, released.

    ts is ``at``, in seconds, as a timestamp.  A lease that runs out is released at that time: when the next
    request for the resource comes, or by a timer once the watermark has passed.  Its owner may extend it before.
    """
    return requests.withWatermark("ts", late).groupBy("resource").transformWithStateInPandas(_Leases(), LEASE_EVENTS, "Append", "EventTime")


def lease_events(requests: DataFrame, until: float = float("inf")) -> DataFrame:
    """The same of a table, with the releases up to a time."""
    held = leases_batch(requests)
    granted = held.where("granted").join(requests.select("resource", "at", "owner", "ttl").distinct(), ["resource", "at", "owner"])
    after = F.lead("at").over(Window.partitionBy("resource").orderBy("at", "owner"))
    ends = granted.withColumn("after", after).withColumn("end", F.col("at") + F.col("ttl")).where("(after is null or after >= end)")
    ends = ends.where(F.col("end") <= until).select("resource", F.col("end").alias("at"), "owner", F.lit("released").alias("event"))
    return held.select("resource", "at", "owner", F.when(F.col("granted"), "granted").otherwise("refused").alias("event")).unionByName(ends)


PROBATION_EVENTS = "base string, seq long, status string, change_id string, reason string, history int"
MOST_HISTORY = 25


def probation_step(active: str | None, circuit: str | None, kind: str, change_id: str | None, executed: int, failed: str | None):
    """(active, circuit, status, change, reason) after one event.

    begin starts a change unless the circuit is open or one is active; evaluate ends the active
    one, promoted if tests ran and none failed, else reverted with the circuit opened; close closes it.
    """
    if kind == "begin":
        if circuit is not None or active is not None:
            return active, circuit, "blocked", change_id, "circuit_open" if circuit is not None else "active_probation"
        return change_id, None, "probation_started", change_id, None
    if kind == "evaluate":
        if active is None:
            return None, circuit, "no_active_probation", None, None
        if executed > 0 and not failed:
            return None, circuit, "promoted", active, None
        why = f"probation_failed:{active}:{failed or 'all_skipped'}"
        return None, why, "reverted", active, why
    if kind == "close":
        return active, None, "circuit_closed", None, circuit
    return active, circuit, "unknown", change_id, kind


def _none(x):
    return None if x is None or x != x else x


def _fold(frame: pd.DataFrame, active, circuit, history: int):
    rows = []
    for seq, kind, change, executed, failed in frame.sort_values("seq")[["seq", "kind", "change_id", "executed", "failed"]].itertuples(index=False):
        active, circuit, status, of, why = probation_step(active, circuit, kind, _none(change), 0 if executed != executed else int(executed), _none(failed))
        history = min(MOST_HISTORY, history + (status in ("promoted", "reverted")))
        rows.append((seq, status, of, why, history))
    return rows, active, circuit, history


def _told(key, rows) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *r) for r in rows], columns=["base", "seq", "status", "change_id", "reason", "history"])


class _Probation(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "active string, circuit string")
        self.ended = handle.getListState("ended", "change_id string, outcome string")

    def handleInputRows(self, key, rows, timerValues):
        active, circuit = self.state.get() if self.state.exists() else (None, None)
        ended = list(self.ended.get())
        out, active, circuit, _ = _fold(pd.concat(list(rows)), active, circuit, len(ended))
        ended = (ended + [(r[2], r[1]) for r in out if r[1] in ("promoted", "reverted")])[-MOST_HISTORY:]
        if ended:
            self.ended.put(ended)
        self.state.update((active, circuit))
        yield _told(key, out)

    def close(self) -> None:
        pass


def probation_stream(events: DataFrame) -> DataFrame:
    """A stream of (base, seq, kind, change_id, executed, failed) events with what each does: probation_step for each base in order of seq, and how many ended changes its history holds."""
    return events.groupBy("base").transformWithStateInPandas(_Probation(), PROBATION_EVENTS, "Append", "None")


def probation_batch(events: DataFrame) -> DataFrame:
    """The same of a table; a base's events follow each other, so a base is one task's work."""
    return events.groupBy("base").applyInPandas(lambda key, frame: _told(key, _fold(frame, None, None, 0)[0]), PROBATION_EVENTS)
