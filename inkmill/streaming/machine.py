"""The life of jobs as a state machine: on a stream with state and timers, and the same over a table of events.

Events are (id, event_id, at, status, file_size): what is asked of a job. They are applied in the order of (at, event_id), each event_id of
a job once. A step that its status doesn't allow is refused and told; a job that nobody created, or that was deleted, takes only an
upload. A job that stays in processing beyond its time fails at that very moment. Both forms give one row a step, so the last accepted
row of a job is its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import NEXT, timeout_seconds

CREATED, RUNNING, DELETED, TIMED_OUT = "uploaded", "processing", "deleted", "timeout"
STEP = "id string, event_id long, at timestamp, before string, status string, accepted boolean, reason string"
#: Bounds of a job's time in seconds, and seconds a megabyte.
BASE, MOST, A_MEGABYTE = 600, 10_800, 600


def allowed(before: Column, status: Column) -> Column:
    """Whether a status may follow another (null: no such job)."""
    table = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.coalesce(F.array_contains(F.try_element_at(table, before), status), F.lit(False))
    return F.when(before.isNull(), status == CREATED).otherwise(known | (status == DELETED) | (before == status))


def history(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """Every step of every job, in order, of a table of events; jobs still in processing at ``upto`` time out if their time is over.

    A job's events are folded as one array, as jobs have tens of them.
    """
    each = events.groupBy("id", "event_id").agg(F.min(F.struct("at", "status", "file_size")).alias("x"))
    item = F.struct(F.col("x.at").alias("at"), "event_id", F.col("x.status").alias("status"), timeout_seconds("x.file_size", BASE, MOST).alias("seconds"))
    jobs = each.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = "array<struct<event_id: bigint, at: timestamp, before: string, status: string, accepted: boolean, reason: string>>"
    text, moment = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    step = lambda event, at, before, status, accepted, reason: F.array(F.struct(event.alias("event_id"), at.alias("at"), before.alias("before"), status.alias("status"), accepted.alias("accepted"), reason.alias("reason")))
    state = lambda status, deadline, steps: F.struct(status.alias("status"), deadline.alias("deadline"), steps.alias("steps"))

    def expired(s: Column, now: Column) -> Column:
        over = step(F.lit(None).cast("bigint"), s["deadline"], s["status"], F.lit("failed"), F.lit(True), F.lit(TIMED_OUT))
        return F.when(s["deadline"] <= now, state(F.lit("failed"), moment, F.concat(s["steps"], over))).otherwise(s)

    def apply(s: Column, x: Column) -> Column:
        ok = allowed(s["status"], x["status"])
        told = F.concat(s["steps"], step(x["event_id"], x["at"], s["status"], x["status"], ok, F.when(ok, text).when(s["status"].isNull(), F.lit("no such job")).otherwise(F.lit("not allowed"))))
        after = F.when(x["status"] == DELETED, text).otherwise(x["status"])
        stays = s["status"].eqNullSafe(x["status"])
        until = F.when(x["status"] != RUNNING, moment).when(stays, s["deadline"]).otherwise(x["at"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x["seconds"]))
        return F.when(ok, state(after, until, told)).otherwise(state(s["status"], s["deadline"], told))

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    start = state(text, moment, F.array().cast(out))
    folded = F.aggregate("items", start, lambda s, x: let(expired(s, x["at"]), lambda t: apply(t, x)))
    if upto is not None:
        folded = let(folded, lambda s: expired(s, upto))
    return jobs.select("id", F.posexplode(folded["steps"]).alias("nth", "s")).select("id", "nth", "s.*")


def states(steps: DataFrame, order: str = "nth") -> DataFrame:
    """(id, status, at) of the jobs that exist: their last accepted step."""
    last = steps.where("accepted").groupBy("id").agg(F.max_by(F.struct("status", "at"), order).alias("x"))
    return last.where(F.col("x.status") != DELETED).select("id", "x.status", "x.at")


class JobMachine(StatefulProcessor):
    """A job's state with its pending events: they wait until the watermark has passed them, so that order doesn't depend on arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long, event_id long", "status string, file_size long")
        self.job = handle.getValueState("job", "status string, deadline long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, event, status, size in zip(batch["at"], batch["event_id"], batch["status"], batch["file_size"], strict=True):
                us = int(at.value // 1000)
                self.pending.updateValue((us, int(event)), (status, int(size) if pd.notna(size) else 0))
                self.handle.registerTimer(us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k[0], k[1], v[0], v[1]) for k, v in self.pending.iterator() if k[0] < now)
        status, deadline = self.job.get() if self.job.exists() else (None, None)
        steps, seen = [], set()

        def expire(until: int) -> None:
            nonlocal status, deadline
            if deadline is not None and deadline <= until:
                steps.append((None, deadline, status, "failed", True, TIMED_OUT))
                status, deadline = "failed", None

        for us, event, wanted, size in ready:
            self.pending.removeKey((us, event))
            if event in seen:
                continue
            seen.add(event)
            expire(us)
            ok = wanted == CREATED if status is None else wanted == DELETED or wanted == status or wanted in NEXT.get(status, ())
            steps.append((event, us, status, wanted, ok, None if ok else "no such job" if status is None else "not allowed"))
            if ok and not (wanted == RUNNING == status):
                deadline = us + int(max(BASE, min(size / (1024 * 1024) * A_MEGABYTE, MOST))) * 1_000_000 if wanted == RUNNING else None
                if deadline is not None:
                    self.handle.registerTimer(deadline // 1000 + 1)
                status = None if wanted == DELETED else wanted
        expire(now - 1)
        if status is None:
            self.job.clear()
        else:
            self.job.update((status, deadline))
        if steps:
            made = pd.DataFrame(steps, columns=["event_id", "at", "before", "status", "accepted", "reason"])
            yield pd.DataFrame({"id": key[0], "event_id": made["event_id"].astype("Int64"), "at": pd.to_datetime(made["at"], unit="us"), "before": made["before"], "status": made["status"], "accepted": made["accepted"].astype(bool), "reason": made["reason"]})

    def close(self) -> None:
        pass


def job_steps(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of steps from a stream of events(id, event_id, at, status, file_size); events later than ``late`` are dropped.

    Needs the state store of transformWithState (spark.sql.streaming.stateStore.providerClass: RocksDB).
    """
    watched = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id", "event_id"])
    return watched.groupBy("id").transformWithStateInPandas(statefulProcessor=JobMachine(), outputStructType=STEP, outputMode="Append", timeMode="EventTime")
