"""I rows: progress events (batch form; streams are tested against these)."""

from pyspark.sql import functions as F

from cueloom.plans.registry import query
from cueloom.streaming import progress as P

MAPPED = """mp AS (SELECT event_id, job_id, ts_us, name, position, total, CASE name WHEN 'ASR_STARTED' THEN 'Transcribing' WHEN 'ASR_PROGRESS' THEN 'Transcribing' WHEN 'JOB_COMPLETED' THEN 'Completed' ELSE 'Translating' END AS stage,
  CASE name WHEN 'ASR_STARTED' THEN 4 WHEN 'ASR_PROGRESS' THEN 4 + 81 * position / 100.0 WHEN 'TRANSLATION_STARTED' THEN 88 WHEN 'TRANSLATION_PROGRESS' THEN 88 + 10 * position / 100.0 ELSE 100 END::DOUBLE AS progress FROM fx_job_events),
lg AS (SELECT *, lag(stage) OVER w AS prev FROM mp WINDOW w AS (PARTITION BY job_id ORDER BY ts_us, event_id)),
sn AS (SELECT *, max(CASE WHEN prev IS DISTINCT FROM stage THEN ts_us END) OVER (PARTITION BY job_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS since FROM lg)"""


def mapped(fx):
    return P.map_progress(fx.job_events)


def changes(fx):
    s = F.element_at(F.array(*map(F.lit, ["queued", "running", "failed", "completed", "failed"])), (F.col("event_id") % 5 + 1).cast("int"))
    return fx.job_events.select("job_id", "event_id", "ts_us", s.alias("status"))


CHANGES = "ch AS (SELECT job_id, event_id, ts_us, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 3 THEN 'completed' ELSE 'failed' END AS status FROM fx_job_events)"


@query("i1_map_progress", f"WITH {MAPPED} SELECT event_id, stage, round(progress, 6) AS progress FROM mp")
def _(fx):
    return mapped(fx).select("event_id", "stage", F.round("progress", 6).alias("progress"))


@query("i2_phase_durations", f"""WITH {MAPPED}, st AS (SELECT job_id, stage, ts_us, lead(ts_us) OVER (PARTITION BY job_id ORDER BY ts_us, event_id) AS nxt FROM lg WHERE prev IS DISTINCT FROM stage)
SELECT job_id, stage, ts_us AS started_us, nxt - ts_us AS duration_us FROM st WHERE nxt IS NOT NULL""")
def _(fx):
    return P.phase_durations(mapped(fx))


@query("i3_phase_eta", f"""WITH {MAPPED} SELECT job_id, event_id, CASE WHEN name LIKE '%PROGRESS' AND position BETWEEN 2 AND 99 THEN round((ts_us - since)::DOUBLE * (100 - position) / position / 1000, 2) END AS eta_ms FROM sn""")
def _(fx):
    return P.phase_eta(mapped(fx)).select("job_id", "event_id", F.round(F.col("eta_us") / 1000, 2).alias("eta_ms"))


@query("i4_thin_progress")
def _(fx):
    return P.thin_progress(mapped(fx))


@query("i5_latest_per_job", f"WITH {CHANGES} SELECT job_id, event_id, ts_us, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_us DESC, event_id DESC) AS r FROM ch) WHERE r = 1")
def _(fx):
    return P.latest_per_key(changes(fx))


@query("i6_failure_transitions", f"WITH {CHANGES} SELECT job_id, event_id, ts_us FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts_us, event_id) AS p FROM ch) WHERE status = 'failed' AND p <> 'failed'")
def _(fx):
    return P.failure_transitions(changes(fx))


@query("i7_live_status_counts", f"WITH {CHANGES} SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_us DESC, event_id DESC) AS r FROM ch) WHERE r = 1 GROUP BY 1")
def _(fx):
    return P.live_status_counts(changes(fx))
