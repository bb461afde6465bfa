"""Job states from event streams, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import write_chunks
from ..sources.versions import VersionedStore

#: Stage floors in percent, by a word of the progress message.
STAGES = [("识别", 25), ("提取", 75), ("生成", 90)]
FINAL = ["completed", "ingested", "failed", "cancelled"]


def latest_state(events: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """Each key's last status, time and number of events; works on a stream in complete or update mode."""
    last = F.max_by(F.struct(status, at), F.struct(at, tie))
    return events.groupBy(key).agg(last.alias("x"), F.count("*").alias("n_events")).select(key, F.col(f"x.{status}").alias("status"), F.col(f"x.{at}").alias("updated_at"), "n_events")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and kind, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def progress_percent(message: str = "progress"):
    """The floor of the stage that a progress message names, 0 without one."""
    out = F.lit(0)
    for word, floor in STAGES:
        out = F.when(F.contains(F.col(message), F.lit(word)), floor).otherwise(out)
    return out


def with_before(rows: DataFrame, key: str, at: str, value: str, block: Column | None = None) -> DataFrame:
    """rows with before, the value of the key's row before (null at the first).

    Rows look back within a block of ``at``, an hour or 65,536 numbers unless ``block`` tells them (it must grow with at); the first of a block takes
    the last value of the block before it, found among one row a block. So no task holds all rows of a key.
    """
    whole = block if block is not None else F.floor(F.col(at) / 65_536) if rows.schema[at].dataType.typeName() in ("integer", "long", "short") else F.date_trunc("hour", at)
    each = rows.withColumn("_block", whole)
    last = each.groupBy(key, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), at).alias("_v"))
    led = last.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.lag("_v").over(Window.partitionBy(key).orderBy("_block")).alias("_led")).where("_led IS NOT NULL")
    w = Window.partitionBy(key, "_block").orderBy(at)
    each = each.withColumns({"_nth": F.row_number().over(w), "before": F.lag(value).over(w)})
    first = each["_block"].eqNullSafe(led["_at"]) & each[key].eqNullSafe(led["_key"]) & (F.col("_nth") == 1)
    out = each.join(led, first, "left").withColumn("before", F.when(F.col("_nth") == 1, F.col("_led.v")).otherwise(F.col("before")))
    return out.drop("_block", "_nth", "_key", "_at", "_led")


def changes(states: DataFrame, key: str, at: str, value: str, block: Column | None = None) -> DataFrame:
    """Rows whose value differs from the one before it."""
    return with_before(states, key, at, value, block).where(~F.col(value).eqNullSafe(F.col("before"))).drop("before")


def timeout_seconds(size: str = "file_size", base: int = 600, most: int = 10_800):
    """Seconds a job may take: 600 a megabyte, between base and most."""
    return F.greatest(F.lit(base), F.least(F.col(size) / (1024 * 1024) * 600, F.lit(most))).cast("int")


def merge_jobs(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The job list after a poll: new rows in, known ones updated, missing ones dropped; known tells which were there.

    What a poll leaves null, or has no column for, stays as it was.
    """
    was = old.select(F.col(key).alias("_key"), F.lit(True).alias("known"), *(F.col(c).alias(f"_{c}") for c in old.columns if c != key))
    rows = new.join(was, F.col(key) == F.col("_key"), "left")
    own = [c for c in old.columns if c != key]
    kept = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in new.columns else F.col(f"_{c}").alias(c) for c in own]
    return rows.select(key, *kept, *(c for c in new.columns if c != key and c not in own), F.coalesce("known", F.lit(False)).alias("known"))


#: Which statuses may follow a status; the final ones may be taken up again.
NEXT = {
    "uploaded": ["queued", "processing", "failed", "cancelled"], "queued": ["processing", "failed", "cancelled", "cancelling"], "processing": ["completed", "failed", "cancelling", "cancelled"],
    "cancelling": ["cancelled", "failed", "completed"], "completed": ["ingesting", "ingested", "failed", "queued"], "ingesting": ["ingested", "completed", "failed"], "ingested": ["completed", "ingesting"], "failed": ["queued", "processing"], "cancelled": ["queued"],
}


def illegal_steps(events: DataFrame, key: str = "id", status: str = "status", at: str = "at") -> DataFrame:
    """(key, at, before, status): steps from one status to another that the job states don't allow."""
    allowed = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = with_before(events.select(key, at, status), key, at, status).select(key, at, "before", status).where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
    return rows.where(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col(status)), F.lit(False)))


def completed_again(jobs: DataFrame, sources: list[str], source: str = "filename") -> DataFrame:
    """jobs after their sources went from the store: ingested ones are completed again."""
    hit = F.col(source).isin(sources) & (F.col("status") == "ingested")
    return jobs.withColumn("status", F.when(hit, "completed").otherwise(F.col("status")))


def replace_output(jobs: DataFrame, job_id: str) -> DataFrame:
    """A job's output replaced: ingested goes back to completed, and modify_count grows by one."""
    hit = F.col("id") == job_id
    status = F.when(hit & (F.col("status") == "ingested"), "completed").otherwise(F.col("status"))
    return jobs.withColumn("status", status).withColumn("modify_count", F.coalesce("modify_count", F.lit(0)) + hit.cast("int"))


def ingest(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Chunk what arrives and put it into the store, source by source; stops when all that is there is read."""

    def one(batch: DataFrame, _: int) -> None:
        write_chunks(chunker(batch), store)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], store: VersionedStore, writer: str, checkpoint: str) -> StreamingQuery:
    """``ingest`` into a store of snapshots: a batch that comes again after a failure is taken in once."""

    def one(batch: DataFrame, number: int) -> None:
        store.commit(writer, number, chunker(batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
