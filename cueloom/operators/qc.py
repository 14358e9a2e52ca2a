"""Quality rules. Every rule yields rows of one findings table:
``keys, stage, category, reason, confidence, index``.

Rules read one cue at a time, or the running end of earlier cues through a
block scan, so a very long track never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import once, scan

# Stages, review categories and thresholds.
STAGES = ("transcription", "hallucination", "translation", "entity", "timing", "segmentation", "readability", "output")
CUE_STAGES = ("output", "readability", "timing")
REVIEW_CATEGORIES = ("entity_error", "hallucination")
REVIEW_CONFIDENCE = 0.7
DURATION_CONFIDENCE = 0.5
LOW_LOGPROB = -0.8
PLACEHOLDER = r"\bX[a-z]{2}\b"


@dataclass(frozen=True)
class Constraints:
    """Display limits; pass your own to override."""

    min_ms: int = 500
    max_ms: int = 7000
    target_min_ms: int = 1000
    max_line_chars: int = 42
    max_lines: int = 2
    max_cps: float = 21.0
    target_cps: float = 17.0


def _finding(stage: str, category: str | Column, reason: str | Column, confidence: float | Column, index: str | Column) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    idx = F.col(index) if isinstance(index, str) else index
    return [F.lit(stage).alias("stage"), lit(category).alias("category"), lit(reason).alias("reason"), lit(confidence).cast("double").alias("confidence"), idx.cast("bigint").alias("index")]


def qc_transcription(scored: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "seg_idx") -> DataFrame:
    """Anomaly scores first, then plain low decoder confidence."""
    hit = F.col("score") > 0
    low = F.col("avg_logprob") <= LOW_LOGPROB
    category = F.when(hit & F.col("suppressed"), "hallucination").otherwise("unknown")
    reason = F.when(hit, F.array_join("reasons", "; ")).otherwise(F.format_string("low decoder confidence (avg_logprob=%.2f)", "avg_logprob"))
    return scored.where(hit | low).select(*keys, *_finding("transcription", category, reason, F.when(hit, F.col("score")).otherwise(0.3), idx))


def qc_translation(pairs: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "idx") -> DataFrame:
    """First matching rule per (source, translated) row."""
    s, t = F.col("source"), F.col("translated")
    ls, lt = F.length(s), F.length(t)
    n = F.size(X.words(s))
    rules = [
        (X.strip(t) == "", "translation_error", F.lit("empty translation"), 1.0),
        (t.rlike(PLACEHOLDER), "entity_error", F.lit("leaked glossary placeholder"), 0.9),
        (X.unbalanced_brackets(t), "translation_error", F.lit("unbalanced brackets"), 0.6),
        ((ls >= 15) & (lt * 4 < ls), "substitution", F.lit("suspiciously short vs. source length"), 0.5),
        ((ls >= 5) & (lt * 2 > ls * 7), "translation_error", F.lit("suspiciously long vs. source length"), 0.5),
        (X.is_run_on(s), "translation_error", F.format_string("unpunctuated multi-clause source (%d words, no sentence-ending punctuation)", n), 0.4),
    ]
    rule = F.coalesce(*[F.when(cond, F.struct(F.lit(cat).alias("c"), why.alias("r"), F.lit(conf).alias("p"))) for cond, cat, why, conf in rules])
    hits = pairs.withColumn("_r", rule).where(F.col("_r").isNotNull())
    return hits.select(*keys, *_finding("translation", F.col("_r.c"), F.col("_r.r"), F.col("_r.p"), idx))


def qc_repeats(pairs: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "idx") -> DataFrame:
    """A translation repeated for a different source, against the previous holder of the text."""
    d = pairs.withColumn("_key", X.casefold(X.strip("translated"))).withColumn("_src", X.casefold(X.strip("source")))
    d = d.where(F.length("_key") >= 8)
    d = scan(d, [*keys, "_key"], idx, {"_prior": ("last", F.struct(F.col(idx).alias("i"), F.col("_src").alias("s")))})
    hit = d.where(F.col("_prior.s") != F.col("_src"))
    reason = F.format_string("repeated translation matches unrelated sentence %d", F.col("_prior.i"))
    return hit.select(*keys, *_finding("translation", "substitution", reason, 0.5, idx))


def qc_entity(report: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "idx") -> DataFrame:
    """Shortfalls only: more names in the source than in the translation."""
    reason = F.format_string("'%s' occurs %dx in source, %dx in translation", "canonical", "source_count", "target_count")
    return report.where("source_count > target_count").select(*keys, *_finding("entity", "entity_error", reason, 1.0, idx))


def _running_end(cues: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    return scan(cues, keys, idx, {"_prev_end": ("max", "end_ms")})


def _fault(stage: str, category: str, reason: str | Column, confidence: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(stage).alias("s"), F.lit(category).alias("c"), lit(reason).alias("r"), lit(confidence).cast("double").alias("p"))


def _timing_faults() -> list[Column]:
    bad, over = F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") < F.col("_prev_end")
    return [F.when(bad | over, _fault("timing", "timing_difference", F.when(bad, "non-positive duration").otherwise("overlaps previous cue"), 0.9))]


def _readability_faults(limits: Constraints) -> list[Column]:
    ms = F.col("end_ms") - F.col("start_ms")
    rules = [
        (F.size("lines") > limits.max_lines, "too many lines", 0.8),
        (F.exists("lines", lambda x: F.length(x) > limits.max_line_chars), "a line exceeds max character length", 0.6),
        (ms < limits.min_ms, "duration below minimum", DURATION_CONFIDENCE),
        (ms > limits.max_ms, "duration exceeds maximum", DURATION_CONFIDENCE),
        ((ms > 0) & (F.length("text") * 1000 > F.lit(limits.max_cps) * ms), "reading speed exceeds maximum", 0.5),
    ]
    return [F.coalesce(*[F.when(c, _fault("readability", "readability_error", why, conf)) for c, why, conf in rules])]


def _output_faults(empty: Column, slack_ms: int) -> list[Column]:
    timing = F.when(F.col("end_ms") <= F.col("start_ms"), "non-positive duration").when(F.col("start_ms") < F.col("_prev_end") - slack_ms, "overlaps previous cue")
    return [F.when(empty, _fault("output", "readability_error", "empty cue text", 1.0)), F.when(timing.isNotNull(), _fault("output", "timing_difference", timing, 1.0))]


def _found(d: DataFrame, faults: Sequence[Column], keys: Sequence[str], idx: str) -> DataFrame:
    hits = d.select(*keys, idx, F.explode(F.array_compact(F.array(*faults))).alias("_f"))
    return hits.select(*keys, F.col("_f.s").alias("stage"), F.col("_f.c").alias("category"), F.col("_f.r").alias("reason"), F.col("_f.p").alias("confidence"), F.col(idx).cast("bigint").alias("index"))


def _is_empty() -> Column:
    return X.strip("text") == ""


def qc_timing(cues: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "cue_idx") -> DataFrame:
    return _found(_running_end(cues, keys, idx), _timing_faults(), keys, idx)


def qc_readability(cues: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "cue_idx", limits: Constraints = Constraints()) -> DataFrame:
    """At most one finding per cue, in rule order."""
    return _found(cues, _readability_faults(limits), keys, idx)


def qc_output(cues: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "cue_idx", slack_ms: int = 10) -> DataFrame:
    """Validity of written cues; an empty text may co-occur with a timing fault."""
    return _found(_running_end(cues, keys, idx), _output_faults(_is_empty(), slack_ms), keys, idx)


def qc_cues(cues: DataFrame, keys: Sequence[str] = ("media_id",), idx: str = "cue_idx", limits: Constraints = Constraints(), slack_ms: int = 10) -> DataFrame:
    """Timing, readability and output findings in one pass: the running end is taken once, over rows without their texts."""
    slim = cues.select(*keys, idx, "start_ms", "end_ms", _readability_faults(limits)[0].alias("_r"), _is_empty().alias("_empty"))
    d = _running_end(slim, keys, idx)
    return _found(d, [*_timing_faults(), F.col("_r"), *_output_faults(F.col("_empty"), slack_ms)], keys, idx)


def qc_summary(findings: DataFrame, populations: DataFrame, keys: Sequence[str] = (), retried: Column | None = None, improved: Column | None = None) -> DataFrame:
    """Denominators and counts per stage; stages without findings stay at zero.

    ``retried`` and ``improved`` say of a finding whether it had a second attempt and whether that was better;
    a retried finding that is not (or not known to be) improved is unresolved. Without them nobody retried.
    """
    by = [*keys, "stage"]
    again = F.coalesce(retried, F.lit(False)) if retried is not None else F.lit(False)
    good = again & (F.coalesce(improved, F.lit(False)) if improved is not None else F.lit(False))
    counts = {"flagged": F.lit(True), "retried": again, "improved": good, "unresolved": again & ~good}
    hits = findings.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return populations.join(hits, by, "left").select(*by, "population", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def review_flag(category: Column, confidence: Column) -> Column:
    return category.isin(*REVIEW_CATEGORIES) | (F.coalesce(confidence, F.lit(0.0)) >= REVIEW_CONFIDENCE)


def needs_review(findings: DataFrame, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """Findings a person must look at; source-side stages do not count."""
    own = F.col("stage").isin(*STAGES)
    return findings.groupBy(*keys).agg(F.count_if(own & review_flag(F.col("category"), F.col("confidence"))).alias("needs_review"))


def job_valid(findings: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """Valid when coverage, timing and output carry no finding."""
    gate = findings.where(F.col("stage").isin("segmentation", "timing", "output")).groupBy(*keys).agg(F.count("*").alias("_n"))
    return jobs.select(*keys).join(gate, list(keys), "left").select(*keys, F.col("_n").isNull().alias("valid"))


def flagged_cues(findings: DataFrame, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """Distinct cue numbers with a finding in a cue-indexed stage, one row each."""
    return findings.where(F.col("stage").isin(*CUE_STAGES) & F.col("index").isNotNull()).select(*keys, "index").distinct()


QC_REPORT = (
    "map<string, struct<population:double, flagged:double, unresolved:double, "
    "findings:array<struct<category:string, reason:string, confidence:double, index:bigint>>>>"
)


def recount_reviews(jobs: DataFrame) -> DataFrame:
    """Review counts under the current policy; readability duration findings weigh 0.5."""

    def stage_count(stage: Column, result: Column) -> Column:
        softened = lambda f: F.when((stage == "readability") & F.startswith(f["reason"], F.lit("duration ")), F.lit(DURATION_CONFIDENCE)).otherwise(f["confidence"])
        kept = F.filter(result["findings"], lambda f: review_flag(F.coalesce(f["category"], F.lit("")), softened(f)))
        return F.coalesce(F.size(kept), F.lit(0)).cast("bigint")

    report = F.from_json("qc", QC_REPORT)
    parts = F.transform(F.map_entries(report), lambda e: stage_count(e["key"], e["value"]))
    after = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = F.coalesce("needs_review", F.lit(0)).cast("bigint")
    d = jobs.where(F.col("qc").isNotNull()).select("id", before.alias("before"), after.alias("after"))
    return d.withColumn("changed", F.col("before") != F.col("after"))


def _positive(value: Column) -> Column:
    """Missing and negative numbers count as zero; JSON carries no NaN or infinity."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def review_contributions(qc: Column, needs: Column, log: Column) -> Column:
    """Weighted review features of one job, in report order."""

    def item(feature: str | Column, value: Column, stage: Column) -> Column:
        name = feature if isinstance(feature, Column) else F.lit(feature)
        return F.struct(stage.alias("stage"), name.alias("feature"), F.round(value, 4).alias("value"))

    def finding(stage: Column, f: Column) -> Column:
        cat = F.lower(F.coalesce(f["category"], F.lit("")))
        conf = F.least(F.lit(1.0), _positive(f["confidence"]))
        name = F.when(cat == "entity_error", "entity_finding").when(cat == "hallucination", "hallucination_finding").when(cat == "translation_error", "translation_finding").otherwise("other_high_confidence")
        value = F.when(cat.isin("entity_error", "hallucination"), 4 + 4 * conf).when(cat == "translation_error", 3 * conf).when(conf > 0.7, 2 * (conf - 0.7)).otherwise(0.0)
        return item(name, value, stage)

    def per_stage(e: Column) -> Column:
        stage, r = e["key"], e["value"]
        pop = _positive(r["population"])
        rate = F.when(pop > 0, F.least(F.lit(2.0), 2 * _positive(r["flagged"]) / pop)).otherwise(0.0)
        own = F.transform(F.coalesce(r["findings"], F.array().cast("array<struct<category:string,reason:string,confidence:double,index:bigint>>")), lambda f: finding(stage, f))
        return F.concat(own, F.array(item("flagged_rate", rate, stage), item("unresolved", F.least(F.lit(2.0), 0.5 * _positive(r["unresolved"])), stage)))

    none = F.lit(None).cast("string")
    level = lambda name: F.coalesce(F.size(F.filter(log, lambda e: F.lower(e["level"]) == name)), F.lit(0))
    rows = F.flatten(F.transform(F.array_sort(F.coalesce(F.map_keys(qc), F.array().cast("array<string>"))), lambda k: per_stage(F.struct(k.alias("key"), qc[k].alias("value")))))
    tail = F.array(
        item("needs_review", F.least(F.lit(2.0), 0.2 * _positive(needs.cast("double"))), none),
        item("log_severity", F.least(F.lit(2.0), F.greatest(level("error"), F.lit(0)) + 0.25 * F.greatest(level("warning"), F.lit(0))), none),
    )
    return F.filter(F.concat(rows, tail), lambda c: c["value"] > 0)


def rank_reviews(jobs: DataFrame) -> DataFrame:
    """Completed jobs by review score; every contribution is kept.

    Scoring is row-local. Ranks come from a block scan over (score, id) rather
    than one global sort task.
    """
    log = F.from_json("log", "array<struct<level:string, message:string>>")
    d = jobs.where(F.col("status") == "completed").select("id", "needs_review", once(F.from_json("qc", QC_REPORT)).alias("qc"), log.alias("log"))
    d = d.select("id", once(review_contributions(F.col("qc"), F.col("needs_review"), F.col("log"))).alias("contributions"))
    score = F.round(F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["value"]), 4)
    d = d.select("*", once(score).alias("score")).where("score > 0").withColumn("_down", -F.round(F.col("score") * 10000).cast("bigint"))
    blocks = F.struct(F.col("_down"), F.floor(F.col("id") / 65536).alias("b"))
    d = scan(d, [], "_down", {"_before": ("count", F.lit(1))}, ties=["id"], block_by=blocks)
    return d.select("id", "score", (F.col("_before") + 1).alias("rank"), "contributions")
