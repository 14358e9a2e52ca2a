"""Anomalous-segment scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import once, rank_pick

# Signal thresholds and the built-in signatures.
COMPRESSION_FROM = 2.4
COMPRESSION_SPAN = 10.0
NO_SPEECH = 0.6
LOW_LOGPROB = -1.0
SUPPRESS_AT = 0.75
SIGNATURES = (
    ("tr-subtitle-credit-altyazi", "tr", r"\baltyaz[ıi]\b", "subtitle_credit", 0.9),
    ("audio-description-disclaimer", "tr", "sesli betimleme|betimleme derneğine", "broadcast_boilerplate", 0.5),
    ("tr-thanks-for-watching", "tr", r"zlediğiniz\s+için\s+teşekkür", "outro_boilerplate", 0.9),
)
#: Signatures that may be broadcast.
MAX_RULES = 10_000
PERCENTILES = {"p50": (50, 100), "p90": (90, 100), "p95": (95, 100), "p99": (99, 100), "p99_9": (999, 1000), "p100": (100, 100)}


def default_signatures(spark) -> DataFrame:
    return spark.createDataFrame(list(SIGNATURES), "id string, language string, pattern string, category string, weight double")


def match_signatures(segments: DataFrame, signatures: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds the ids and the best weight of matching signatures.

    Signatures are folded into one row per language, so the join adds no rows and
    needs no regrouping. Up to MAX_RULES of them (counted) are sent to all tasks, so
    segments are not shuffled on the few languages; beyond, the join shuffles.
    """
    rules = signatures.groupBy(F.col("language").alias(lang)).agg(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("(?iuU)"), "pattern").alias("pattern"), "weight"))).alias("_rules"))
    d = segments.join(F.broadcast(rules) if signatures.count() <= MAX_RULES else rules, lang, "left")
    hits = F.filter(F.coalesce("_rules", F.array().cast("array<struct<id:string,pattern:string,weight:double>>")), lambda r: F.rlike(F.col("text"), r["pattern"]))
    d = d.select(*segments.columns, once(hits).alias("_hits"))
    return d.select(
        *segments.columns,
        F.transform("_hits", lambda r: r["id"]).alias("signature_ids"),
        F.coalesce(F.array_max(F.transform("_hits", lambda r: r["weight"])), F.lit(0.0)).alias("signature_score"),
    )


def compression_score(ratio: Column, span: float = COMPRESSION_SPAN) -> Column:
    return F.when(ratio < COMPRESSION_FROM, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * (ratio - COMPRESSION_FROM) / span))


def no_speech_score(prob: Column, text: Column) -> Column:
    return F.when((prob >= NO_SPEECH) & (X.strip(text) != ""), 0.4).otherwise(0.0)


def logprob_score(logprob: Column) -> Column:
    return F.when(logprob <= LOW_LOGPROB, 0.3).otherwise(0.0)


def decoder_signals(segments: DataFrame) -> DataFrame:
    return segments.withColumns({
        "no_speech_score": no_speech_score(F.col("no_speech_prob"), F.col("text")),
        "compression_score": compression_score(F.col("compression_ratio")),
        "logprob_score": logprob_score(F.col("avg_logprob")),
    })


def recurrence_score(segments: DataFrame, key: str = "media_id") -> DataFrame:
    """How often and how widely the same text recurs in its track.

    One aggregate per (track, text) and one equi join replace the all-pairs
    comparison; a text that fills a third of a track is a single pre-aggregated row.
    """
    norm = F.regexp_replace(X.casefold(X.strip("text")), r"(?U)\s+", " ")
    d = segments.withColumn("_norm", F.when(F.size(X.words("text")) >= 3, norm))
    seen = d.where(F.col("_norm").isNotNull()).groupBy(key, "_norm").agg(
        F.count("*").alias("_n"), F.min("start_ms").alias("_lo"), F.max("start_ms").alias("_hi")).where("_n >= 3")
    length = segments.groupBy(key).agg(F.max("end_ms").alias("_dur"))
    spread = F.when(F.col("_dur") > 0, (F.col("_hi") - F.col("_lo")) / F.col("_dur")).otherwise(0.0)
    score = F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), (F.col("_n") - 1) / 4) + 0.5 * F.least(F.lit(1.0), spread / 0.3))
    # scored per recurring text, so segments with their texts move once, for the join back
    scored = seen.join(length, key).select(key, "_norm", score.alias("recurrence"))
    kept = [c for c in segments.columns if c != "recurrence"]
    return d.drop("recurrence").join(scored, [key, "_norm"], "left").select(*kept, F.coalesce("recurrence", F.lit(0.0)).alias("recurrence"))


def combine_scores(d: DataFrame) -> DataFrame:
    """Final score, reasons in rule order, and suppression by the unrounded score."""
    other = F.greatest("signature_score", "no_speech_score", "compression_score", "logprob_score")
    raw = F.when(F.col("recurrence") > 0, F.when(other > 0, F.least(F.lit(1.0), other + 0.3 * F.col("recurrence"))).otherwise(0.6 * F.col("recurrence"))).otherwise(other)
    reasons = F.concat(
        F.transform("signature_ids", lambda s: F.concat(F.lit("signature:"), s)),
        F.array_compact(F.array(
            F.when(F.col("no_speech_score") > 0, F.format_string("no_speech_prob=%.2f with decoded text present", "no_speech_prob")),
            F.when(F.col("compression_ratio") >= COMPRESSION_FROM, F.format_string("compression_ratio=%.2f (degenerate/repetitive text, score=%.2f)", "compression_ratio", "compression_score")),
            F.when(F.col("avg_logprob") <= LOW_LOGPROB, F.format_string("avg_logprob=%.2f (low decoder confidence)", "avg_logprob")),
            F.when(F.col("recurrence") > 0, F.format_string("recurrence_score=%.2f (verbatim text recurs widely across the episode)", "recurrence")),
        )),
    )
    return d.withColumn("_raw", raw).withColumns({"score": F.round("_raw", 3), "suppressed": F.col("_raw") >= SUPPRESS_AT, "reasons": reasons}).drop("_raw")


def score_segments(segments: DataFrame, signatures: DataFrame | None = None, key: str = "media_id", lang: str = "lang") -> DataFrame:
    sigs = default_signatures(segments.sparkSession) if signatures is None else signatures
    return combine_scores(decoder_signals(recurrence_score(match_signatures(segments, sigs, lang), key)))


def is_loop_shaped(text: str | Column, min_chars: int = 10, max_distinct: float = 0.2) -> Column:
    packed = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(" "), F.lit(""))
    letters = F.filter(F.split(packed, ""), lambda c: c != "")
    return (F.length(packed) >= min_chars) & (F.size(F.array_distinct(letters)) <= F.lit(max_distinct) * F.length(packed))


def signal_percentiles(df: DataFrame, value: str, keys: Sequence[str] = (), points: Mapping[str, tuple[int, int]] = PERCENTILES) -> DataFrame:
    """Nearest-rank percentiles, 0-based position ``min(n-1, floor(n*p))``, of an integer column."""
    at = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * num / den)) for name, (num, den) in points.items()}
    return rank_pick(df, keys, value, at)


def what_if(scored: DataFrame, span: float) -> DataFrame:
    """Segments another compression span would newly suppress."""
    new = F.greatest(F.col("score"), compression_score(F.col("compression_ratio"), span))
    return scored.where(~F.col("suppressed") & (new >= SUPPRESS_AT))
