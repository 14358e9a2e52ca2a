"""Transcript preparation and coverage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import BLOCK_MS, scan

# Coverage, loop and rule thresholds.
GAP_MS = 15_000
SHORT_SPARSE_MS = 10_000
SPARSE_DENSITY = 2.5
SHORT_SPARSE_DENSITY = 1.0
LOOP_COMPRESSION = 7.4
DECODER_COMPRESSION = 2.4
MIN_WORD_MS = 10
MIN_RULE_CONFIDENCE = 0.85
LOW_LANGUAGE_CONFIDENCE = 0.5
STREAM_EXCLUSIONS = ("commentary", "director", "description", "descriptive", "narration", "narrator", "sdh")
CLOSE_SCORE = 0.15
# Three-letter to two-letter language codes.
LANGUAGE_CODES = {
    "tur": "tr", "eng": "en", "jpn": "ja", "kor": "ko", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de",
    "rus": "ru", "ara": "ar", "ita": "it", "por": "pt", "chi": "zh", "zho": "zh", "nld": "nl", "dut": "nl", "pol": "pl",
    "swe": "sv", "vie": "vi", "tha": "th", "hin": "hi", "ell": "el", "gre": "el", "heb": "he", "ces": "cs", "cze": "cs",
    "dan": "da", "fin": "fi", "nor": "no", "ron": "ro", "rum": "ro", "ukr": "uk", "ind": "id", "msa": "ms", "may": "ms",
    "tam": "ta", "tel": "te", "mal": "ml", "kan": "kn", "ben": "bn", "mar": "mr",
}


def normalize_raw_words(words: DataFrame) -> DataFrame:
    """Decoder words to words: no blanks, trimmed, positive length, glue flag."""
    return words.where(X.strip("word") != "").select(
        *[c for c in words.columns if c not in ("word", "end_ms")],
        X.strip("word").alias("text"),
        F.greatest(F.col("end_ms"), F.col("start_ms") + MIN_WORD_MS).alias("end_ms"),
        (~F.col("word").rlike("^[  ]")).alias("joins_previous"),
    )


def join_tokens(tokens: Column, lang: Column) -> Column:
    """Running text from ordered (text, joins_previous) structs."""
    kept = F.filter(tokens, lambda t: F.coalesce(t["text"], F.lit("")) != "")
    glued = F.transform(kept, lambda t, i: F.when((i == 0) | t["joins_previous"] | t["text"].rlike(r"(?U)^['’]\w"), t["text"]).otherwise(F.concat(F.lit(" "), t["text"])))
    return F.when(lang.isin(*X.UNSPACED), F.array_join(F.transform(kept, lambda t: t["text"]), "")).otherwise(F.array_join(glued, ""))


def render_words(words: DataFrame, keys: Sequence[str], order: str = "word_idx", lang: str = "lang") -> DataFrame:
    """Text of each group of words; groups are segments or cues, never whole tracks."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "text", "joins_previous")))
    return words.groupBy(*keys).agg(ordered.alias("_t"), F.first(lang).alias("_lang")).select(*keys, join_tokens(F.col("_t"), F.col("_lang")).alias("text"))


def coverage_gaps(segments: DataFrame, durations: DataFrame | None = None, key: str = "media_id", min_ms: int = GAP_MS) -> DataFrame:
    """Uncovered stretches, including the head and (with a duration) the tail."""
    d = scan(segments, [key], "start_ms", {"_end": ("max", "end_ms")}, ties=["seg_idx"], block=BLOCK_MS)
    start = F.greatest(F.coalesce("_end", F.lit(0)), F.lit(0)).cast("bigint")
    gaps = d.select(key, start.alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
    if durations is not None:
        last = segments.groupBy(key).agg(F.max("end_ms").alias("_end"))
        tail = durations.join(last, key, "left").select(key, start.alias("gap_start_ms"), F.col("duration_ms").alias("gap_end_ms"))
        gaps = gaps.unionByName(tail)
    return gaps.where(F.col("gap_end_ms") - F.col("gap_start_ms") >= min_ms)


def is_sparse(ms: Column, chars: Column) -> Column:
    density = chars * 1000 / ms
    return F.when(ms < SHORT_SPARSE_MS, False).when(ms < GAP_MS, density <= SHORT_SPARSE_DENSITY).otherwise(density <= SPARSE_DENSITY)


def is_loop(ms: Column, compression: Column) -> Column:
    return (ms >= SHORT_SPARSE_MS) & (compression >= LOOP_COMPRESSION)


def loop_segments(segments: DataFrame) -> DataFrame:
    return segments.where(is_loop(F.col("end_ms") - F.col("start_ms"), F.col("compression_ratio")))


def sparse_segments(segments: DataFrame) -> DataFrame:
    """Long segments that hold too little text; loops are handled on their own."""
    ms = F.col("end_ms") - F.col("start_ms")
    return segments.where(is_sparse(ms, F.col("text_len")) & ~is_loop(ms, F.col("compression_ratio")))


def splice_redecodes(segments: DataFrame, alternatives: DataFrame, key: str = "media_id") -> DataFrame:
    """Replace suspicious segments by their re-decodes where those are better.

    ``alternatives`` rows carry ``span_seg_idx`` (NULL for a gap fill). Gap fills
    are always taken; a loop needs every re-decode non-empty and below the
    decoder threshold; a sparse segment needs more text in total. Columns that both
    sides have (text, words, confidences) come along.
    """
    carried = [c for c in segments.columns if c in alternatives.columns and c not in (key, "seg_idx", "start_ms", "end_ms", "text_len")]
    ms = F.col("end_ms") - F.col("start_ms")
    loop = is_loop(ms, F.col("compression_ratio"))
    kind = F.when(loop, "loop").when(is_sparse(ms, F.col("text_len")), "sparse")
    base = segments.select(*segments.columns, kind.alias("_kind"))
    clean = (F.col("text_len") > 0) & (F.coalesce("compression_ratio", F.lit(float("inf"))) < DECODER_COMPRESSION)
    votes = alternatives.where(F.col("span_seg_idx").isNotNull()).groupBy(key, F.col("span_seg_idx").alias("seg_idx")).agg(
        F.bool_and(clean).alias("_clean"), F.sum("text_len").alias("_alt_len"))
    judged = base.join(votes, [key, "seg_idx"], "left")
    take = F.when(F.col("_kind") == "loop", F.coalesce("_clean", F.lit(False))).when(F.col("_kind") == "sparse", F.coalesce("_alt_len", F.lit(0)) > F.col("text_len")).otherwise(False)
    judged = judged.withColumn("_take", take)
    kept = judged.where(~F.col("_take")).select(key, "start_ms", "end_ms", "text_len", *carried, F.lit("original").alias("origin"))
    taken = judged.where("_take").select(key, F.col("seg_idx").alias("span_seg_idx"))
    swapped = alternatives.where(F.col("span_seg_idx").isNotNull()).join(taken, [key, "span_seg_idx"], "left_semi")
    filled = alternatives.where(F.col("span_seg_idx").isNull())
    new = swapped.unionByName(filled).select(key, "start_ms", "end_ms", "text_len", *carried, F.lit("redecode").alias("origin"))
    return kept.unionByName(new)


def majority_language(votes: DataFrame, key: str = "media_id") -> DataFrame:
    """Most votes, then best mean confidence; the result weighs in the agreement."""
    # exact sums: equal means tie in whatever order rows are added
    mean = F.sum(F.col("confidence").cast("decimal(28,18)")).cast("double") / F.count("confidence")
    per = votes.where(F.col("lang").isNotNull()).groupBy(key, "lang").agg(F.count("*").alias("n"), mean.alias("mean"))
    # language codes compare ascending on a full tie
    best = F.min_by(F.struct("lang", "n", "mean"), F.struct(-F.col("n"), F.coalesce(-F.col("mean"), F.lit(float("inf"))), "lang"))
    return per.groupBy(key).agg(best.alias("b"), F.sum("n").alias("all")).select(
        key, F.col("b.lang").alias("lang"), (F.col("b.mean") * F.col("b.n") / F.col("all")).alias("probability"))


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per key by partial aggregation, so a hot key never meets in one sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(ts, *ties))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def canonical_json(fields: dict) -> Column:
    """JSON text with sorted keys and spaced separators; nested dicts recurse."""

    def value(v) -> Column:
        if isinstance(v, dict):
            return canonical_json(v)
        c = v if isinstance(v, Column) else F.lit(v)
        text = F.to_json(F.array(c))
        return F.coalesce(F.when(c.isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2)), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def provenance_key(fields: dict) -> Column:
    """SHA-256 over every input that can change a transcript; leave the language out for AUTO."""
    return F.sha2(canonical_json(fields), 256)


def validate_hits(requests: DataFrame, cached: DataFrame, model_prefix: str = "faster-whisper-") -> DataFrame:
    """Cache hits whose own recorded fields agree with the request."""
    r, c = requests.alias("r"), cached.alias("c")
    joined = r.join(c, F.col("r.cache_key") == F.col("c.cache_key"))
    same = [F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}")) for f in ("media_hash", "audio_stream_index", "pipeline_version")]
    same.append(F.concat(F.lit(model_prefix), F.col("r.model_name")) == F.col("c.model_name"))
    ok = same[0] & same[1] & same[2] & same[3]
    return joined.select(F.col("r.request_id"), F.col("c.media_hash").alias("media_hash"), F.coalesce(ok, F.lit(False)).alias("valid"))


@dataclass(frozen=True)
class WordRule:
    rule_id: str
    language: str
    pattern: str
    replacement: str
    evidence: str = ""
    confidence: float = 1.0


# The one confirmed transliteration rule.
WORD_RULES = (WordRule("tr-petunia-petunya", "tr", r"\bpetunia\b", "petunya", "confirmed against a human reference"),)


def apply_word_rules(words: DataFrame, rules: Sequence[WordRule] = WORD_RULES) -> DataFrame:
    """Whole-word respelling in the rule's language, matching the case of the hit."""
    text, log = F.col("text"), F.array().cast("array<struct<rule_id:string,evidence:string,confidence:double>>")
    for r in (r for r in rules if r.confidence >= MIN_RULE_CONFIDENCE):
        pattern = f"(?iuU){r.pattern}"
        hit = F.regexp_extract(text, pattern, 0)
        found = (F.col("lang") == r.language) & (hit != "")
        shaped = (
            F.when((F.upper(hit) == hit) & (F.lower(hit) != hit), F.lit(r.replacement.upper()))
            .when(F.substring(hit, 1, 1) != F.lower(F.substring(hit, 1, 1)), F.lit(r.replacement.capitalize()))
            .otherwise(F.lit(r.replacement))
        )
        entry = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.evidence).alias("evidence"), F.lit(float(r.confidence)).alias("confidence"))
        log = F.when(found, F.array_append(log, entry)).otherwise(log)
        text = F.when(found, F.regexp_replace(text, F.lit(pattern), shaped)).otherwise(text)
    return words.withColumns({"original_text": F.col("text"), "corrections": log, "text": text})


def live_words(words: DataFrame, segments: DataFrame, keys: Sequence[str] = ("media_id", "seg_idx")) -> DataFrame:
    """Words of segments that were not suppressed."""
    return words.join(segments.where("suppressed").select(*keys), list(keys), "left_anti")


def uncertain_language(mode: Column, probability: Column, threshold: float = LOW_LANGUAGE_CONFIDENCE) -> Column:
    return F.coalesce((mode == "AUTO") & (probability < threshold), F.lit(False))


def normalize_lang(code: str | Column) -> Column:
    c = F.lower(F.nullif(F.col(code) if isinstance(code, str) else code, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.when(F.length(c) == 2, c).otherwise(F.coalesce(table[c], F.substring(c, 1, 2)))


def exclusion_reason() -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("handler_name", F.lit(""))))
    words = [F.when(F.contains(hay, F.lit(k)), f"title/handler mentions '{k}'") for k in STREAM_EXCLUSIONS]
    return F.coalesce(
        F.when(F.col("commentary"), "commentary disposition"),
        F.when(F.col("visual_impaired"), "audio-description / visual-impaired disposition"),
        F.when(F.col("hearing_impaired"), "hearing-impaired disposition"),
        *words,
    )


def rank_streams(streams: DataFrame, probes: DataFrame, preferred: str | None = None) -> DataFrame:
    """Rank the audio streams of each file; a file's stream list is a few rows.

    Excluded streams drop out unless that would leave none. The preferred
    language outranks the score; alternates lie within 0.15 of the best.
    """
    file = Window.partitionBy("media_id")
    s = streams.withColumn("_why", exclusion_reason())
    s = s.withColumn("_all_out", F.min(F.col("_why").isNotNull().cast("int")).over(file) == 1)
    s = s.where(F.col("_why").isNull() | F.col("_all_out")).join(probes, ["media_id", "stream_index"], "left")
    zero = F.lit(0.0)
    own = normalize_lang("language")
    score = (
        F.coalesce(0.45 * F.col("confidence"), zero)
        + F.when(F.col("is_default"), 0.2).otherwise(zero)
        + F.when(own == F.col("detected"), 0.15).otherwise(zero)
        + F.when(F.col("channels") >= 2, 0.05).otherwise(zero)
        + F.when(F.col("duration_ms") >= 0.9 * F.col("total_ms"), 0.05).otherwise(zero)
    )
    s = s.withColumn("score", score)
    off = F.lit(0) if preferred is None else (~F.col("detected").eqNullSafe(normalize_lang(F.lit(preferred)))).cast("int")
    order = Window.partitionBy("media_id").orderBy(off, F.desc("score"), "stream_index")
    s = s.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("_best", F.first("score").over(order))
    close = (F.col("rank") > 1) & (F.col("_best") - F.col("score") <= CLOSE_SCORE)
    return s.select("media_id", "stream_index", "detected", "score", "rank", close.alias("alternate"))
