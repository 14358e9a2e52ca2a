"""Progress events: the same rules over batch tables and over streams.

Event-time policy (ours): 10-minute watermark, state is dropped when a job
stays silent for an hour of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueloom.functions.sequence import scan
from cueloom.functions.units import stream_groups, unit_starts, with_unit

WATERMARK = "10 minutes"
IDLE_MS = 3_600_000
LOG_STEP, MIN_DELTA = 5, 0.5
EVENT_BLOCK_US = 3_600_000_000

# Stage label and percent per event, and bands of the fine-grained events.
VIDEO = {
    "MEDIA_INSPECTION_STARTED": ("Inspecting media", 0), "AUDIO_SELECTED": ("Inspecting media", 1), "AUDIO_EXTRACTION_STARTED": ("Extracting audio", 1),
    "AUDIO_EXTRACTION_COMPLETED": ("Extracting audio", 4), "ASR_CACHE_HIT": ("Transcribing (cached)", 85), "ASR_STARTED": ("Transcribing", 4), "ASR_COMPLETED": ("Transcribing", 85),
    "LANGUAGE_DETECTED": ("Detecting language", 86), "HALLUCINATION_CHECK_STARTED": ("Checking for hallucinations", 86), "HALLUCINATION_CHECK_COMPLETED": ("Checking for hallucinations", 87),
    "SOURCE_SEGMENTATION_COMPLETED": ("Segmenting transcript", 88), "TRANSLATION_STARTED": ("Translating", 88), "TRANSLATION_SKIPPED": ("Translating", 98), "TRANSLATION_COMPLETED": ("Translating", 98),
    "ENTITY_RECOVERY_APPLIED": ("Finalizing translation", 98), "TARGET_SEGMENTATION_COMPLETED": ("Formatting subtitles", 99), "PROJECTION_VALIDATED": ("Validating output", 99),
    "READABILITY_TIMING_EXTENDED": ("Validating output", 99), "QC_COMPLETED": ("Running quality checks", 99), "OUTPUT_COMMITTED": ("Writing output", 99), "JOB_COMPLETED": ("Completed", 100),
}
SRT = {
    "SRT_PARSE_STARTED": ("Parsing SRT", 0), "SRT_PARSE_COMPLETED": ("Parsing SRT", 3), "LANGUAGE_DETECTED": ("Detecting language", 5), "TRANSLATION_STARTED": ("Translating", 5),
    "TRANSLATION_SKIPPED": ("Translating", 90), "TRANSLATION_COMPLETED": ("Translating", 90), "ENTITY_RECOVERY_APPLIED": ("Finalizing translation", 92),
    "TARGET_SEGMENTATION_COMPLETED": ("Formatting subtitles", 95), "QC_COMPLETED": ("Running quality checks", 97), "OUTPUT_COMMITTED": ("Writing output", 99), "JOB_COMPLETED": ("Completed", 100),
}
RETIME = {
    "RETIME_STARTED": ("Reading subtitle", 0), "RETIME_PARSE_COMPLETED": ("Reading subtitle", 3), "ASR_CACHE_HIT": ("Transcribing", 90), "RETIME_TRANSCRIPT_READY": ("Aligning", 92),
    "RETIME_ALIGNED": ("Aligning", 97), "OUTPUT_COMMITTED": ("Writing output", 99), "JOB_COMPLETED": ("Completed", 100),
}
FINE = {
    "video": {"ASR_PROGRESS": ("Transcribing", 4, 85), "TRANSLATION_PROGRESS": ("Translating", 88, 98)},
    "srt_translation": {"SRT_TRANSLATION_PROGRESS": ("Translating", 5, 90)},
    "subtitle_retime": {"ASR_PROGRESS": ("Transcribing", 4, 90)},
}
MILESTONES = {"video": VIDEO, "srt_translation": SRT, "subtitle_retime": RETIME}


def _fraction() -> Column:
    return F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("position", F.lit(0)) / F.col("total")).otherwise(0.0)


def map_progress(events: DataFrame, job_type: str = "video") -> DataFrame:
    """Adds (stage, progress); events without a milestone are dropped. Works on streams."""
    stage = progress = F.lit(None)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _fraction()))
    for name, (label, at) in MILESTONES[job_type].items():
        stage, progress = F.when(F.col("name") == name, label).otherwise(stage), F.when(F.col("name") == name, float(at)).otherwise(progress)
    for name, (label, lo, hi) in FINE[job_type].items():
        stage, progress = F.when(F.col("name") == name, label).otherwise(stage), F.when(F.col("name") == name, lo + inside * (hi - lo)).otherwise(progress)
    return events.withColumns({"stage": stage, "progress": progress, "fine": F.col("name").isin(*FINE[job_type])}).where("stage IS NOT NULL")


def _since(events: DataFrame, key: str) -> DataFrame:
    """When the current stage of each event began."""
    d = scan(events, [key], "ts_us", {"_p": ("last", F.struct("stage"))}, ties=["event_id"], block=EVENT_BLOCK_US)
    d = d.withColumn("_new", ~F.coalesce(F.col("_p.stage") == F.col("stage"), F.lit(False)))
    return scan(d, [key], "ts_us", {"since_us": ("max", F.when(F.col("_new"), F.col("ts_us")))}, ties=["event_id"], inclusive=True, block=EVENT_BLOCK_US)


def phase_durations(mapped: DataFrame, key: str = "job_id") -> DataFrame:
    """One row per finished phase: from its first event to the next phase's first event."""
    d = _since(mapped, key).where("_new")
    d = scan(d, [key], "ts_us", {"_prev": ("last", F.struct("stage", "ts_us"))}, ties=["event_id"], block=EVENT_BLOCK_US).where("_prev IS NOT NULL")
    return d.select(key, F.col("_prev.stage").alias("stage"), F.col("_prev.ts_us").alias("started_us"), (F.col("ts_us") - F.col("_prev.ts_us")).alias("duration_us"))


def phase_eta(mapped: DataFrame, key: str = "job_id") -> DataFrame:
    """Remaining microseconds of the phase for work-counted events between 2% and 100%."""
    f = _fraction()
    d = _since(mapped, key)
    eta = F.when(F.col("fine") & (f >= 0.02) & (f < 1), (F.col("ts_us") - F.col("since_us")) * (F.col("total") - F.col("position")) / F.col("position"))
    return d.select(key, "event_id", eta.alias("eta_us"))


def thin_progress(mapped: DataFrame, key: str = "job_id") -> DataFrame:
    """Which events are logged (once per 5% of a stage) and written (stage change, 0.5 points, or milestone)."""
    tick = F.col("name").endswith("_PROGRESS")
    part = tick & (F.coalesce("total", F.lit(0)) > 0) & (F.col("position") < F.col("total"))
    d = mapped.withColumn("_b", F.when(part, F.floor(F.floor(100 * F.col("position") / F.col("total")) / LOG_STEP)))
    d = scan(d, [key, "name"], "ts_us", {"_seen": ("max", "_b")}, ties=["event_id"], block=EVENT_BLOCK_US)
    d = d.withColumn("logged", F.col("_b").isNull() | (F.col("_b") > F.coalesce("_seen", F.lit(-1)))).withColumn("hard", ~tick)
    d = d.select(key, "event_id", "ts_us", "stage", "progress", "logged", "hard")

    by = [key, "unit"]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        first = unit_starts(rows, by)
        order = np.lexsort((rows["event_id"], rows["ts_us"], first.cumsum()))
        rows = rows.iloc[order]
        # units keep their places, so a unit opens where one did before
        last, out = (None, -1.0), []
        for opens, stage, progress, hard in zip(first.tolist(), rows["stage"].tolist(), rows["progress"].tolist(), rows["hard"].tolist(), strict=True):
            write = opens or hard or stage != last[0] or abs(progress - last[1]) >= MIN_DELTA
            last = (stage, progress) if write else last
            out.append(write)
        return rows[[key, "event_id", "logged"]].assign(written=out)

    placed = with_unit(d, [key], "ts_us", F.col("hard"), EVENT_BLOCK_US)
    return stream_groups(placed, by, "ts_us", fold, f"{key} bigint, event_id bigint, logged boolean, written boolean")


def latest_per_key(changes: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    """One pending change per job: the newest, by partial aggregation."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(key, "_b.*")


def failure_transitions(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Changes to failed from any other status."""
    d = scan(changes, [key], "ts_us", {"_p": ("last", "status")}, ties=["event_id"], block=EVENT_BLOCK_US)
    return d.where((F.col("status") == "failed") & F.col("_p").isNotNull() & (F.col("_p") != "failed")).select(key, "event_id", "ts_us")


def live_status_counts(changes: DataFrame, key: str = "job_id") -> DataFrame:
    return latest_per_key(changes, key).groupBy("status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams

def _event_time(stream: DataFrame) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", WATERMARK)


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(["ts_us", "event_id"]) if parts else pd.DataFrame()


def _keep(state: GroupState, value: tuple, rows: pd.DataFrame) -> None:
    state.update(value)
    now = max(int(rows["ts_us"].max() // 1000), state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(now + IDLE_MS)


def stream_phase_durations(mapped: DataFrame, key: str = "job_id") -> DataFrame:
    """Phase durations from an unbounded feed; state per job is one (stage, since) pair."""
    def step(job, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        stage, since = state.get if state.exists else (None, None)
        out = []
        for name, ts in zip(rows["stage"], rows["ts_us"]):
            if name != stage:
                if stage is not None:
                    out.append((job[0], stage, since, int(ts) - since))
                stage, since = name, int(ts)
        _keep(state, (stage, since), rows)
        yield pd.DataFrame(out, columns=[key, "stage", "started_us", "duration_us"])

    return _event_time(mapped).groupBy(key).applyInPandasWithState(
        step, f"{key} bigint, stage string, started_us bigint, duration_us bigint", "stage string, since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_failure_transitions(changes: DataFrame, key: str = "job_id") -> DataFrame:
    def step(job, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        last, out = (state.get[0] if state.exists else None), []
        for status, event, ts in zip(rows["status"], rows["event_id"], rows["ts_us"]):
            if status == "failed" and last not in (None, "failed"):
                out.append((job[0], event, ts))
            last = status
        _keep(state, (last,), rows)
        yield pd.DataFrame(out, columns=[key, "event_id", "ts_us"])

    return _event_time(changes).groupBy(key).applyInPandasWithState(step, f"{key} bigint, event_id bigint, ts_us bigint", "status string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_latest(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Newest change per job as a running aggregate (update or complete mode)."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts_us", "event_id")).alias("_b")).select(key, "_b.*")


def write_latest(changes: DataFrame, path: str, checkpoint: str, key: str = "job_id"):
    """Coalesce each micro-batch to one change per job and store it by batch number."""
    def store(batch: DataFrame, number: int) -> None:
        # a replayed batch overwrites its own folder
        latest_per_key(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()
