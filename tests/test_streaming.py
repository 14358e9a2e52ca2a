"""Streams give the batch rows."""

from pyspark.sql import functions as F

from cueloom.streaming import progress as P

SF = "/root/testdata/sf0.001"


def events(df):
    n = F.element_at(F.array(*map(F.lit, ["ASR_STARTED", "ASR_PROGRESS", "TRANSLATION_STARTED", "TRANSLATION_PROGRESS"])), (F.col("event_id") % 4 + 1).cast("int"))
    s = F.element_at(F.array(*map(F.lit, ["queued", "running", "failed", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    return df.select("event_id", F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), n.alias("name"), s.alias("status"), (F.col("event_id") % 101).alias("position"), F.lit(100).alias("total"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark):
    path = f"{SF}/events.parquet"
    raw = spark.read.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(f"{SF}/events*.parquet")
    batch = events(raw)
    want = {tuple(r) for r in P.phase_durations(P.map_progress(batch)).collect()}
    assert {tuple(r) for r in drain(P.stream_phase_durations(P.map_progress(events(stream))), "phases").collect()} == want
    fails = {tuple(r) for r in P.failure_transitions(batch).collect()}
    assert {tuple(r) for r in drain(P.stream_failure_transitions(events(stream)), "fails").collect()} == fails
    latest = {(r.job_id, r.event_id) for r in P.latest_per_key(batch).collect()}
    assert {(r.job_id, r.event_id) for r in drain(P.stream_latest(events(stream)), "latest", "complete").collect()} == latest
