"""H rows: job analytics."""

from pyspark.sql import functions as F

from cueloom.operators import jobs as J
from cueloom.plans.registry import query

NOW = 1_000_000_000


def wide(fx):
    """Job rows with the extra columns the operators read."""
    k = F.col("id")
    return fx.jobs.select(
        "*",
        (F.col("created_at") + (k % 977) * 60).alias("updated_at"),
        F.when(k % 4 != 0, F.col("created_at") + 30).alias("started_at"),
        F.when(F.col("status").isin("completed", "failed", "skipped"), F.col("created_at") + 30 + k % 500).alias("finished_at"),
        (k % 7 == 0).alias("cancel_requested"),
        F.when(k % 5 == 0, "srt_translation").otherwise("video").alias("job_type"),
        (k % 2 == 0).alias("source_is_uploaded"),
        F.when(k % 3 != 1, F.concat(F.md5((k % 997).cast("string")), F.lit(".srt"))).alias("source_srt_path"),
    )


WIDE = """wide AS (SELECT *, created_at + (id % 977)*60 AS updated_at, CASE WHEN id % 4 <> 0 THEN created_at + 30 END AS started_at,
  CASE WHEN status IN ('completed','failed','skipped') THEN created_at + 30 + id % 500 END AS finished_at, id % 7 = 0 AS cancel_requested,
  CASE WHEN id % 5 = 0 THEN 'srt_translation' ELSE 'video' END AS job_type, id % 2 = 0 AS source_is_uploaded,
  CASE WHEN id % 3 <> 1 THEN md5(CAST(id % 997 AS VARCHAR)) || '.srt' END AS source_srt_path FROM fx_jobs)"""


@query("h1_status_counts", """
SELECT upper(s) AS status, (SELECT count(*) FROM fx_jobs j WHERE j.status = s) AS n
FROM (VALUES ('queued'),('running'),('completed'),('failed'),('skipped'),('cancelled')) v(s)
UNION ALL SELECT 'ALL', count(*) FROM fx_jobs""")
def _(fx):
    return J.status_counts(fx.jobs)


@query("h2_job_page", "SELECT id, status, created_at FROM fx_jobs WHERE status = 'running' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def _(fx):
    return J.job_page(fx.jobs, "RUNNING", 50, 100).select("id", "status", "created_at")


@query("h2_job_total", "SELECT count(*) AS total FROM fx_jobs WHERE status = 'running'")
def _(fx):
    return J.job_total(fx.jobs, "Running")


@query("h3_series_rollup", f"""
WITH {WIDE} SELECT tvdb_id, count(*) FILTER (status='queued') AS queued, count(*) FILTER (status='running') AS running,
  count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed, count(*) FILTER (status='skipped') AS skipped,
  count(*) FILTER (status='cancelled') AS cancelled, count(*) AS total, count(DISTINCT video_path) AS episodes, max(updated_at) AS last_updated
FROM wide GROUP BY tvdb_id""")
def _(fx):
    return J.series_rollup(wide(fx))


@query("h4_latest_path", f"""
WITH {WIDE} SELECT tvdb_id, video_path FROM (SELECT *, row_number() OVER (PARTITION BY tvdb_id ORDER BY updated_at DESC, id DESC) AS r
FROM wide WHERE tvdb_id IS NOT NULL) WHERE r = 1""")
def _(fx):
    return J.latest_path(wide(fx))


@query("h4_series_jobs", "SELECT id, video_path, status FROM fx_jobs WHERE tvdb_id IS NULL")
def _(fx):
    return J.series_jobs(fx.jobs, None).select("id", "video_path", "status")


@query("h5_active_sources", f"""WITH {WIDE} SELECT DISTINCT source_srt_path FROM wide
WHERE source_is_uploaded AND status IN ('queued','running') AND source_srt_path IS NOT NULL""")
def _(fx):
    return J.active_sources(wide(fx))


@query("h6_duplicate_active", f"""WITH {WIDE} SELECT job_type, video_path, count(*) AS n, min(id) AS first_id FROM wide
WHERE status IN ('queued','running') GROUP BY 1, 2 HAVING count(*) > 1""")
def _(fx):
    return J.duplicate_active(wide(fx))


@query("h7_lifecycle", f"""WITH {WIDE} SELECT id, CASE WHEN status = 'running' AND cancel_requested THEN 'CANCELLING' WHEN status = 'completed' THEN 'SUCCEEDED' ELSE upper(status) END AS lifecycle,
 CASE WHEN started_at IS NULL THEN 0 WHEN status IN ('queued','running') THEN {NOW} - started_at ELSE coalesce(finished_at, updated_at, started_at) - started_at END AS elapsed FROM wide""")
def _(fx):
    return J.with_lifecycle(wide(fx), F.lit(NOW).cast("bigint")).select("id", "lifecycle", "elapsed")


# jobs with every column that recovery touches, also on rows that it must leave alone
H8_JOBS = """(SELECT *, CASE WHEN id % 3 = 0 THEN 'EARLIER' END AS error_category, CASE WHEN id % 4 = 0 THEN 500 + id END AS finished_at,
  CASE WHEN id % 5 = 0 THEN id END AS last_recovered_at, CASE WHEN id % 5 = 0 THEN 'before' END AS last_recovery_reason,
  CASE WHEN id % 7 = 0 THEN 'odd' END AS error, id AS started_at, id + 1 AS updated_at, 'STEP' AS stage, CAST(id % 100 AS INTEGER) AS progress
  FROM (SELECT id, status, recovery_count FROM fx_jobs))"""


@query("h8_recover_orphans", f"""
SELECT id, CASE WHEN NOT r THEN status WHEN again THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN NOT r THEN stage WHEN again THEN 'QUEUED' ELSE 'FAILED' END AS stage, CASE WHEN r AND NOT again THEN 100 ELSE progress END AS progress,
  CASE WHEN r AND again THEN recovery_count + 1 ELSE recovery_count END AS recovery_count,
  CASE WHEN r AND NOT again THEN 'ORPHANED_JOB_RECOVERY_EXHAUSTED' ELSE error_category END AS error_category,
  CASE WHEN r AND NOT again THEN {NOW} ELSE finished_at END AS finished_at, CASE WHEN r AND again THEN NULL ELSE started_at END AS started_at,
  CASE WHEN r THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN r THEN {NOW} ELSE last_recovered_at END AS last_recovered_at,
  CASE WHEN r AND NOT again THEN spent ELSE error END AS error,
  CASE WHEN r AND again THEN 'Process restarted while this job was running; automatically requeued (' || (recovery_count + 1) || '/3).' WHEN r THEN spent ELSE last_recovery_reason END AS last_recovery_reason
FROM (SELECT *, status = 'running' AS r, recovery_count < 3 AS again,
  'Job was interrupted by restarts ' || recovery_count || ' times; automatic recovery limit (3) reached. Use Retry to create a new attempt.' AS spent FROM {H8_JOBS})""")
def _(fx):
    when = lambda test, value: F.when(F.expr(test), value)
    jobs = fx.jobs.select("id", "status", "recovery_count").withColumns({
        "error_category": when("id % 3 = 0", F.lit("EARLIER")), "finished_at": when("id % 4 = 0", 500 + F.col("id")), "last_recovered_at": when("id % 5 = 0", F.col("id")),
        "last_recovery_reason": when("id % 5 = 0", F.lit("before")), "error": when("id % 7 = 0", F.lit("odd")), "started_at": F.col("id"),
        "updated_at": F.col("id") + 1, "stage": F.lit("STEP"), "progress": F.expr("CAST(id % 100 AS INT)"),
    })
    return J.recover_orphans(jobs, F.lit(NOW).cast("bigint"))


@query("h9_retry_lineage", """
SELECT id, root_id, depth FROM (
  WITH RECURSIVE up(id, root_id, parent, depth) AS (
    SELECT id, id, retry_of_job_id, 0::BIGINT FROM fx_jobs
    UNION ALL SELECT up.id, j.id, j.retry_of_job_id, up.depth + 1 FROM up JOIN fx_jobs j ON j.id = up.parent)
  SELECT id, root_id, depth, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS r FROM up) WHERE r = 1""")
def _(fx):
    return J.retry_lineage(fx.jobs)


@query("h10_bound_logs", r"""
WITH entries AS (SELECT media_id, word_idx AS p, text AS m FROM fx_words UNION ALL
  SELECT doc_id, 1000000000, text FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY p DESC) AS r FROM entries),
kept AS (SELECT media_id, p, CASE WHEN length(m) > 4000 THEN substr(m, 1, 3987) || '… [truncated]' ELSE m END AS m FROM ranked WHERE r <= 200)
SELECT media_id, count(*) AS entries, CAST(sum(length(m)) AS BIGINT) AS chars, min_by(m, p) AS first_message, md5(max_by(m, p)) AS last_message FROM kept GROUP BY media_id""")
def _(fx):
    d = fx.spread(fx.table("documents").select("doc_id", "text"))
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    d = d.where(trimmed != "").withColumn("log", F.transform(F.split(trimmed, r"\s+"), lambda w, i: F.struct(i.alias("time"), w.alias("message"))))
    out = d.withColumn("log", J.append_log("log", F.lit(1_000_000_000), F.col("text")))
    m = F.transform("log", lambda e: e["message"])
    return out.select(
        F.col("doc_id").alias("media_id"), F.size("log").cast("bigint").alias("entries"),
        F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"),
        F.element_at(m, 1).alias("first_message"), F.md5(F.element_at(m, -1)).alias("last_message"),
    )


def qc_json(fx):
    """Jobs whose QC report is JSON text, as an export holds it."""
    k = F.col("id")

    def finding(category, confidence, reason="low", index=None):
        return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), confidence.alias("confidence"), (k % 50).alias("index"))

    def stage(*findings, pop, unresolved):
        kept = F.array_compact(F.array(*findings))
        return F.struct(pop.alias("population"), F.size(kept).alias("flagged"), F.lit(0).alias("retried"), F.lit(0).alias("improved"), unresolved.alias("unresolved"), kept.alias("findings"))

    qc = F.create_map(
        F.lit("entity"), stage(F.when(k % 3 == 0, finding("entity_error", F.lit(1.0))), pop=k % 40, unresolved=k % 9),
        F.lit("readability"), stage(
            F.when(k % 2 == 0, finding("readability_error", F.lit(0.8), "duration 9.00s exceeds maximum 7.0s")),
            F.when(k % 5 == 0, finding("readability_error", F.lit(0.8), "3 lines exceeds max 2")), pop=k % 60 + 1, unresolved=F.lit(0)),
        F.lit("transcription"), stage(F.when(k % 7 == 0, finding("hallucination", F.lit(0.5))), F.when(k % 11 == 0, finding("unknown", F.lit(0.3))), pop=F.lit(100), unresolved=F.lit(0)),
        F.lit("translation"), stage(F.when(k % 13 == 0, finding("translation_error", F.lit(0.9))), pop=F.lit(10), unresolved=F.lit(1)),
    )
    return wide(fx).withColumn("needs_review", k % 14).withColumn("qc", F.to_json(qc)).withColumn("log", F.lit("[]")).withColumn("config_snapshot", F.lit("{}"))


@query("h11_job_summaries", """
SELECT id, id % 40 AS entity_population, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS entity_flagged,
  (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS readability_flagged, id % 9 AS entity_unresolved FROM fx_jobs""")
def _(fx):
    s = J.job_summaries(qc_json(fx))
    return s.select(
        "id", F.col("qc.entity.population").alias("entity_population"), F.col("qc.entity.flagged").alias("entity_flagged"),
        F.col("qc.readability.flagged").alias("readability_flagged"), F.col("qc.entity.unresolved").alias("entity_unresolved"))


@query("h12_expired_uploads", f"""WITH {WIDE}, files AS (SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'notes' || o_orderkey || '.srt' ELSE md5(CAST(o_orderkey AS VARCHAR)) || '.srt' END AS name,
  CAST(epoch(o_orderdate) AS BIGINT) AS mtime FROM orders)
SELECT name, mtime FROM files WHERE length(name) = 36 AND regexp_matches(name, '^[0-9a-f]+[.]srt$') AND mtime <= 900000000
  AND name NOT IN (SELECT source_srt_path FROM wide WHERE source_is_uploaded AND status IN ('queued','running') AND source_srt_path IS NOT NULL)""")
def _(fx):
    o = fx.table("orders")
    name = F.when(F.col("o_orderkey") % 10 == 9, F.concat(F.lit("notes"), F.col("o_orderkey").cast("string"))).otherwise(F.md5(F.col("o_orderkey").cast("string")))
    files = o.select(F.concat(name, F.lit(".srt")).alias("name"), F.unix_timestamp("o_orderdate").alias("mtime"))
    return J.expired_uploads(files, wide(fx), F.lit(900_000_000))


@query("h13_stale_work", f"""WITH {WIDE} SELECT d.name, d.mtime FROM (SELECT o_orderkey * 2 AS name, CAST(epoch(o_orderdate) AS BIGINT) AS mtime FROM orders) d
LEFT JOIN wide w ON w.id = d.name WHERE CASE WHEN w.id IS NULL THEN d.mtime <= 900000000 WHEN w.status IN ('queued','running') THEN false
  WHEN w.status = 'failed' THEN coalesce(w.finished_at, d.mtime) <= 900000000 ELSE true END""")
def _(fx):
    dirs = fx.table("orders").select((F.col("o_orderkey") * 2).alias("name"), F.unix_timestamp("o_orderdate").alias("mtime"))
    return J.stale_work(dirs, wide(fx), F.lit(900_000_000))


@query("h14_linear_eta", """SELECT id, CASE WHEN p >= 2 AND p < 100 THEN round(e * (100.0 - p) / p, 3) END AS eta
FROM (SELECT id, id % 101 AS p, 10 + id % 500 AS e FROM fx_jobs)""")
def _(fx):
    j = fx.jobs.select("id", (F.col("id") % 101).alias("p"), (10 + F.col("id") % 500).alias("e"))
    return j.select("id", F.round(J.linear_eta("e", "p"), 3).alias("eta"))
