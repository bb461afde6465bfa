"""Job states: the fold over a table, and the stream with late, repeated and missing events."""

import datetime as dt

from pyspark.sql import functions as F

from inkmill.streaming import machine

SCHEMA = "id string, event_id long, at timestamp, status string, file_size long"
T0 = dt.datetime(2024, 1, 1)


def event(job, n, minute, status, size=0):
    return (job, n, T0 + dt.timedelta(minutes=minute), status, size)


EVENTS = [
    event("a", 1, 0, "uploaded"), event("a", 2, 1, "queued"), event("a", 3, 2, "processing", 2 << 20), event("a", 4, 15, "completed"), event("a", 5, 16, "ingested"), event("a", 5, 16, "ingested"),
    event("b", 1, 0, "uploaded"), event("b", 2, 1, "processing"), event("b", 3, 12, "completed"), event("b", 4, 13, "queued"),  # too late: ten minutes are over
    event("c", 1, 0, "queued"), event("c", 2, 1, "uploaded"), event("c", 3, 2, "ingested"), event("c", 4, 3, "queued"), event("c", 5, 4, "cancelling"), event("c", 6, 5, "cancelled"),
    event("d", 1, 0, "uploaded"), event("d", 2, 1, "deleted"), event("d", 3, 2, "queued"), event("e", 1, 0, "uploaded"), event("e", 2, 3, "processing", 100 << 20),
]


def rows(df):
    return sorted(((r.id, r.at, r.event_id or 0, r.before, r.status, r.accepted, r.reason) for r in df.collect()), key=repr)


def test_history(spark):
    steps = machine.history(spark.createDataFrame(EVENTS, SCHEMA), F.lit(T0 + dt.timedelta(hours=5)))
    got = {(r.id, r.nth): (r.before, r.status, r.accepted, r.reason) for r in steps.collect()}
    assert [got["b", k] for k in range(5)] == [(None, "uploaded", True, None), ("uploaded", "processing", True, None), ("processing", "failed", True, "timeout"), ("failed", "completed", False, "not allowed"), ("failed", "queued", True, None)]
    assert got["c", 0] == (None, "queued", False, "no such job") and got["c", 2] == ("uploaded", "ingested", False, "not allowed") and got["d", 2] == (None, "queued", False, "no such job")
    assert sorted((r.id, r.status, (r.at - T0).seconds // 60) for r in machine.states(steps).collect()) == [("a", "ingested", 16), ("b", "queued", 13), ("c", "cancelled", 5), ("e", "failed", 183)]
    assert machine.history(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    """Events arrive out of order, twice and in many batches; what the stream says in the end is what the table says."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[EVENTS[k] for k in (6, 1, 0, 10, 2, 7)], [EVENTS[k] for k in (12, 11, 2, 3, 9, 8, 16)], EVENTS[4:6] + EVENTS[13:16] + EVENTS[17:] + EVENTS[:2], [event("z", 1, 600, "uploaded")], [event("z", 2, 1200, "queued")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        # Twenty minutes late at most, as the batches are; each run goes on from the checkpoint.
        query = machine.job_steps(stream, "20 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    want = machine.history(spark.createDataFrame(EVENTS, SCHEMA), F.lit(T0 + dt.timedelta(hours=5)))
    assert rows(spark.read.parquet(out).where("id <> 'z'")) == rows(want)
