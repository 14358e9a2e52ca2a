"""Batch analytics over the wide jobs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.session import cut_lineage

# The public job contract.
STATUSES = ("queued", "running", "completed", "failed", "skipped", "cancelled")
ACTIVE = ("queued", "running")
LIFECYCLE = {"queued": "QUEUED", "running": "RUNNING", "completed": "SUCCEEDED", "failed": "FAILED", "cancelled": "CANCELLED", "skipped": "SKIPPED"}
MAX_LOG_ENTRIES = 200
MAX_LOG_CHARS = 4000
LOG_SUFFIX = "… [truncated]"
MAX_RECOVERIES = 3
RECOVERY_EXHAUSTED = "ORPHANED_JOB_RECOVERY_EXHAUSTED"
UPLOAD_NAME = r"^[0-9a-f]{32}\.srt$"


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per upper-case status, zero-filled, plus ``ALL``."""
    zeros = jobs.sparkSession.createDataFrame([(s.upper(), 0) for s in STATUSES], "status string, n bigint")
    counted = jobs.groupBy(F.upper("status").alias("status")).agg(F.count("*").alias("n"))
    return (
        counted.union(zeros).rollup("status").agg(F.sum("n").alias("n"))
        .select(F.coalesce("status", F.lit("ALL")).alias("status"), "n")
    )


def with_status(jobs: DataFrame, status: str | None) -> DataFrame:
    return jobs.where(F.col("status") == status.lower()) if status else jobs


def job_page(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first (ties by id); the limit is the page size itself."""
    return with_status(jobs, status).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def job_total(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return with_status(jobs, status).agg(F.count("*").alias("total"))


def series_rollup(jobs: DataFrame) -> DataFrame:
    """One row per series (NULL is its own series): counts, distinct files, last update."""
    per = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return jobs.groupBy("tvdb_id").agg(
        *per, F.count("*").alias("total"), F.countDistinct("video_path").alias("episodes"), F.max("updated_at").alias("last_updated")
    )


def latest_path(jobs: DataFrame) -> DataFrame:
    known = jobs.where(F.col("tvdb_id").isNotNull())
    return known.groupBy("tvdb_id").agg(F.max_by("video_path", F.struct("updated_at", "id")).alias("video_path"))


def series_jobs(jobs: DataFrame, tvdb_id: int | None) -> DataFrame:
    return jobs.where(F.col("tvdb_id").eqNullSafe(F.lit(tvdb_id).cast("bigint"))).orderBy("video_path", "id")


def active_sources(jobs: DataFrame) -> DataFrame:
    needed = F.col("source_is_uploaded") & F.col("status").isin(*ACTIVE) & F.col("source_srt_path").isNotNull()
    return jobs.where(needed).select("source_srt_path").distinct()


def duplicate_active(jobs: DataFrame, target: str = "video_path") -> DataFrame:
    live = jobs.where(F.col("status").isin(*ACTIVE))
    return live.groupBy("job_type", target).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def lifecycle() -> Column:
    named = F.create_map(*[F.lit(x) for pair in LIFECYCLE.items() for x in pair])
    cancelling = (F.col("status") == "running") & F.col("cancel_requested")
    return F.when(cancelling, "CANCELLING").otherwise(F.coalesce(named[F.col("status")], F.upper("status")))


def elapsed_seconds(now: Column) -> Column:
    started = F.nullif("started_at", F.lit(0))
    end = F.when(F.col("status").isin(*ACTIVE), now).otherwise(F.coalesce(F.nullif("finished_at", F.lit(0)), F.nullif("updated_at", F.lit(0)), started))
    return F.when(started.isNull(), 0).otherwise(end - started)


def with_lifecycle(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.withColumns({"lifecycle": lifecycle(), "elapsed": elapsed_seconds(now)})


def recover_orphans(jobs: DataFrame, now: Column) -> DataFrame:
    """Running rows after a restart: requeue up to three times, then fail. Other rows stay as they are.

    Columns that the table lacks are added; a requeued row loses its start, a failed one is finished.
    """
    running = F.col("status") == "running"
    again = running & (F.col("recovery_count") < MAX_RECOVERIES)
    spent = running & (F.col("recovery_count") >= MAX_RECOVERIES)
    tries = F.col("recovery_count") + 1
    # The messages of the job record.
    again_why = F.format_string("Process restarted while this job was running; automatically requeued (%d/" + str(MAX_RECOVERIES) + ").", tries)
    spent_why = F.format_string(
        "Job was interrupted by restarts %d times; automatic recovery limit (" + str(MAX_RECOVERIES) + ") reached. Use Retry to create a new attempt.",
        F.col("recovery_count"),
    )
    kinds = {"error_category": "string", "last_recovery_reason": "string", "last_recovered_at": "bigint", "started_at": "bigint", "finished_at": "bigint", "updated_at": "bigint", "stage": "string", "error": "string", "progress": "int"}
    have = jobs.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in jobs.columns})
    same = F.col
    return have.withColumns({
        "status": F.when(again, "queued").when(spent, "failed").otherwise(same("status")),
        "stage": F.when(again, "QUEUED").when(spent, "FAILED").otherwise(same("stage")),
        "progress": F.when(spent, 100).otherwise(same("progress")).cast(dict(have.dtypes)["progress"]),
        "error": F.when(spent, spent_why).otherwise(same("error")),
        "error_category": F.when(spent, RECOVERY_EXHAUSTED).otherwise(same("error_category")),
        "last_recovery_reason": F.when(again, again_why).when(spent, spent_why).otherwise(same("last_recovery_reason")),
        "last_recovered_at": F.when(running, now).otherwise(same("last_recovered_at")),
        "started_at": F.when(again, F.lit(None)).otherwise(same("started_at")),
        "finished_at": F.when(spent, now).otherwise(same("finished_at")),
        "updated_at": F.when(running, now).otherwise(same("updated_at")),
        "recovery_count": F.when(again, tries).otherwise(same("recovery_count")),
    })


def retry_lineage(jobs: DataFrame, id_col: str = "id", parent_col: str = "retry_of_job_id") -> DataFrame:
    """Root job and depth of every attempt, by pointer doubling on unique ids.

    Each round doubles the covered distance, so a chain of length ``n`` takes
    ``log2(n)`` equi joins. Attempts whose chain runs into a cycle have no root:
    they come back with a null root and depth.
    """
    links = jobs.select(F.col(id_col).alias("id"), F.col(parent_col).alias("_p"))
    known_ids = jobs.select(F.col(id_col).alias("_p")).distinct().withColumn("_known", F.lit(True))
    # an attempt whose parent row is gone is its own root; `up` is null at a root
    # rows without a parent never move: as null keys of a join they would all meet in one task
    first = lambda d, up: d.select("id", up.alias("up"), F.coalesce(up, "id").alias("top"), up.isNotNull().cast("bigint").alias("depth"))
    known = F.when(F.col("_known"), F.col("_p"))
    tried = cut_lineage(first(links.where("_p IS NOT NULL").join(known_ids, "_p", "left"), known))
    roots = first(links.where("_p IS NULL"), F.lit(None).cast(tried.schema["up"].dataType)).unionByName(tried.where("depth = 0"))
    links = tried.where("depth > 0")
    # chains of distinct ids end within this many doublings; what still points somewhere then is a cycle
    for _ in range(max(1, links.count().bit_length()) + 1):
        ahead = links.select(F.col("id").alias("up"), F.col("up").alias("_u"), F.col("top").alias("_t"), F.col("depth").alias("_d"))
        on = links.where("up IS NOT NULL").join(ahead, "up", "left").select("id", F.col("_u").alias("up"), F.coalesce("_t", "top").alias("top"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        links = cut_lineage(links.where("up IS NULL").unionByName(on))
        if links.where("up IS NOT NULL").isEmpty():
            break
    ended = F.col("up").isNull()
    return roots.unionByName(links).select("id", F.when(ended, F.col("top")).alias("root_id"), F.when(ended, F.col("depth")).alias("depth"))


def bound_log(log: str | Column, entries: int = MAX_LOG_ENTRIES, chars: int = MAX_LOG_CHARS) -> Column:
    """Last ``entries`` entries; a message over ``chars`` characters keeps its head and a marker."""
    log = F.col(log) if isinstance(log, str) else log
    keep = chars - len(LOG_SUFFIX)
    kept = F.when(F.size(log) > entries, F.slice(log, -entries, entries)).otherwise(log)

    def short(e: Column) -> Column:
        text = e["message"]
        return e.withField("message", F.when(F.length(text) > chars, F.concat(F.substring(text, 1, keep), F.lit(LOG_SUFFIX))).otherwise(text))

    return F.transform(kept, short)


def append_log(log: str | Column, at: Column, message: Column) -> Column:
    log = F.col(log) if isinstance(log, str) else log
    entry = F.struct(at.alias("time"), message.alias("message"))
    return bound_log(F.concat(F.coalesce(log, F.array()), F.array(entry)))


QC_COUNTS = "map<string, struct<population:bigint, flagged:bigint, retried:bigint, improved:bigint, unresolved:bigint>>"


def job_summaries(jobs: DataFrame) -> DataFrame:
    """List shape of a job: stage counts only, no findings, log or snapshot."""
    fat = [c for c in ("log", "config_snapshot") if c in jobs.columns]
    return jobs.drop(*fat).withColumn("qc", F.from_json("qc", QC_COUNTS))


def expired_uploads(files: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    old = files.where(F.col("name").rlike(UPLOAD_NAME) & (F.col("mtime") <= cutoff))
    return old.join(active_sources(jobs).withColumnRenamed("source_srt_path", "name"), "name", "left_anti")


def stale_work(dirs: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Work folders that may go: by job state, or by age when no job is left."""
    known = jobs.select(F.col("id").alias("name"), "status", "finished_at")
    stale = (
        F.when(F.col("status").isNull(), F.col("mtime") <= cutoff)
        .when(F.col("status").isin(*ACTIVE), False)
        .when(F.col("status") == "failed", F.coalesce("finished_at", "mtime") <= cutoff)
        .otherwise(True)
    )
    return dirs.join(known, "name", "left").where(stale).select("name", "mtime")


def linear_eta(elapsed: str, progress: str) -> Column:
    """Remaining seconds by straight-line progress; NULL below 2% and at 100%."""
    left = F.col(elapsed) / (F.col(progress) / 100) - F.col(elapsed)
    return F.when((F.col(progress) >= 2) & (F.col(progress) < 100) & (left > 0), left)
