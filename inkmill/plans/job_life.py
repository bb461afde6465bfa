"""Job histories over the table of events, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import machine
from ..streaming.jobs import NEXT

#: What an event asks of its user's job, by number.
ASKED = ["uploaded", "queued", "processing", "completed", "uploaded", "processing", "cancelling", "ingested", "queued", "deleted", "failed"]


def as_job_events(events: DataFrame) -> DataFrame:
    """Users' events as events of one job each."""
    number = F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(len(ASKED))).cast("int")
    return events.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("id"), "event_id", F.col("ts").alias("at"), F.get(F.array(*map(F.lit, ASKED)), number).alias("status"), F.pmod(F.col("event_id") * 7919, F.lit(30_000_000)).alias("file_size"))


def job_history(events: DataFrame) -> DataFrame:
    upto = events.agg(F.max("ts").cast("string")).first()[0]
    return machine.history(as_job_events(events), F.lit(upto).cast("timestamp")).select("id", "event_id", "at", "before", "status", "accepted", "reason")


def job_history_sql() -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, steps in NEXT.items() for b in steps)
    asked = ", ".join(f"'{x}'" for x in ASKED)
    return f"""
WITH RECURSIVE e AS (SELECT 'j' || user_id AS id, event_id, ts AS moment, [{asked}][(event_id * 31 + user_id) % {len(ASKED)} + 1] AS asked,
    CAST(floor(greatest({machine.BASE}, least(event_id * 7919 % 30000000 / 1048576.0::DOUBLE * {machine.A_MEGABYTE}, {machine.MOST}))) AS INT) AS seconds FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment, event_id) AS k FROM e), z AS (SELECT max(moment) AS upto FROM e),
n(b, s) AS (VALUES {pairs}),
r AS (SELECT id, CAST(0 AS BIGINT) AS k, count(*) AS size, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS moment, NULL::VARCHAR AS before, NULL::VARCHAR AS asked, false AS ok, NULL::VARCHAR AS status, NULL::TIMESTAMP AS deadline, NULL::TIMESTAMP AS over_at, NULL::VARCHAR AS over_before FROM o GROUP BY id
  UNION ALL
  SELECT id, k, size, event_id, moment, cur, asked, ok, CASE WHEN NOT ok THEN cur WHEN asked <> 'deleted' THEN asked END,
    CASE WHEN NOT ok THEN CASE WHEN timed THEN NULL ELSE deadline END WHEN asked <> 'processing' THEN NULL WHEN cur = 'processing' THEN deadline ELSE moment + to_seconds(seconds) END,
    CASE WHEN timed THEN deadline END, CASE WHEN timed THEN status END
  FROM (SELECT *, CASE WHEN cur IS NULL THEN asked = 'uploaded' ELSE asked IN ('deleted', cur) OR (cur, asked) IN (SELECT (b, s) FROM n) END AS ok
    FROM (SELECT o.id, o.k, r.size, o.event_id, o.moment, o.asked, o.seconds, r.status, r.deadline, coalesce(r.deadline <= o.moment, false) AS timed, CASE WHEN r.deadline <= o.moment THEN 'failed' ELSE r.status END AS cur
      FROM r JOIN o ON o.id = r.id AND o.k = r.k + 1)))
SELECT id, event_id, moment AS "at", before, asked AS status, ok AS accepted, CASE WHEN NOT ok THEN CASE WHEN before IS NULL THEN 'no such job' ELSE 'not allowed' END END AS reason FROM r WHERE k > 0
UNION ALL SELECT id, NULL, over_at, over_before, 'failed', true, 'timeout' FROM r WHERE over_at IS NOT NULL
UNION ALL SELECT id, NULL, deadline, status, 'failed', true, 'timeout' FROM r, z WHERE k = size AND deadline <= upto
"""
