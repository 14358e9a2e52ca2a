"""Transcripts, credits, streams, annotations and job exports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.sequence import once
from cueloom.sources.subtitles import read_files

WORD = "struct<text:string, original_text:string, start:double, end:double, probability:double, joins_previous:boolean>"
SEGMENT = (
    f"struct<index:bigint, start:double, end:double, words:array<{WORD}>, avg_logprob:double, no_speech_prob:double, compression_ratio:double, "
    "boundary_before:string, hallucination_score:double, hallucination_reasons:array<string>, suppressed:boolean, language:string, lines:array<string>>"
)
TRANSCRIPT = (
    "struct<media_path:string, media_hash:string, audio_stream_index:bigint, language:string, language_probability:double, pipeline_version:string, created_at:double, "
    f"asr_model:struct<name:string, version:string, parameters:map<string,string>>, segments:array<{SEGMENT}>>"
)


def parse_transcripts(files: DataFrame, media_any: Sequence[str] | None = None, version: str | None = None) -> DataFrame:
    """One row per readable transcript; corrupt files drop out, filters apply before exploding."""
    d = files.select("path", once(F.from_json("content", TRANSCRIPT)).alias("t")).where("t.media_path IS NOT NULL AND t.media_hash IS NOT NULL AND t.asr_model IS NOT NULL")
    if media_any:
        hit = F.lit(False)
        for part in media_any:
            hit = hit | F.contains("t.media_path", F.lit(part))
        d = d.where(hit)
    return d.where(F.col("t.pipeline_version") == version) if version is not None else d


def read_transcripts(spark: SparkSession, paths: str | list[str], **filters) -> DataFrame:
    return parse_transcripts(read_files(spark, paths), **filters)


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """Segments in milliseconds with defaults for absent fields."""
    d = transcripts.select("path", "t.media_path", F.inline("t.segments"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    none = F.array().cast("array<string>")
    return d.select(
        "path", "media_path", F.col("index").alias("seg_idx"), F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("end") * 1000).cast("bigint").alias("end_ms"),
        zero("avg_logprob"), zero("no_speech_prob"), zero("compression_ratio"), "boundary_before", F.coalesce("hallucination_score", F.lit(0.0)).alias("score"),
        F.coalesce("hallucination_reasons", none).alias("reasons"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("lines", none).alias("lines"), "words")


def transcript_words(segments: DataFrame) -> DataFrame:
    d = segments.select("path", "seg_idx", F.posexplode("words").alias("word_idx", "w"))
    return d.select(
        "path", "seg_idx", F.col("word_idx").cast("bigint").alias("word_idx"), "w.text", F.coalesce("w.original_text", "w.text").alias("original_text"),
        F.round(F.col("w.start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("w.end") * 1000).cast("bigint").alias("end_ms"), "w.probability", F.coalesce("w.joins_previous", F.lit(False)).alias("joins_previous"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=True, nullValue="\\N", quote="")


def credits_of(episodes: DataFrame, principals: DataFrame, title: Column) -> DataFrame:
    """Character credits of a title: its episodes and its own series-level rows."""
    e = episodes.where(F.col("parent") == title).select(F.col("episode_id").alias("title_id"), F.col("season").try_cast("int").alias("season"), F.col("number").try_cast("int").alias("episode")).where("season IS NOT NULL AND episode IS NOT NULL")
    p = principals.where(F.col("category").isin("actor", "actress") & F.col("characters").isNotNull())
    of = p.join(e, "title_id").unionByName(p.where(F.col("title_id") == title).select("*", F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode")))
    return of.select("season", "episode", F.explode(F.from_json("characters", "array<string>")).alias("character"))


STREAM = (
    "array<struct<index:bigint, codec_type:string, codec_name:string, channels:bigint, sample_rate:string, bit_rate:string, duration:string, "
    "tags:struct<title:string, language:string, handler_name:string>, disposition:struct<default:int, forced:int, hearing_impaired:int, visual_impaired:int, comment:int>>>"
)


def parse_streams(probes: DataFrame, column: str = "streams", key: str = "media_id") -> DataFrame:
    """Audio streams of probe JSON with typed numbers and flags."""
    d = probes.select(key, F.inline(F.from_json(column, STREAM))).where("codec_type = 'audio'")
    flag = lambda n: F.coalesce(F.col(f"disposition.{n}") != 0, F.lit(False))
    return d.select(
        key, F.col("index").alias("stream_index"), F.col("codec_name").alias("codec"), "channels", F.col("sample_rate").try_cast("int").alias("sample_rate"), F.col("bit_rate").try_cast("int").alias("bit_rate"),
        F.round(F.col("duration").try_cast("double") * 1000).cast("bigint").alias("duration_ms"), "tags.title", "tags.language", "tags.handler_name", flag("default").alias("is_default"), flag("forced").alias("forced"),
        flag("hearing_impaired").alias("hearing_impaired"), flag("visual_impaired").alias("visual_impaired"), flag("comment").alias("commentary"))


def parse_points(files: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(points in ms, rejects) of annotation files: one number per line, ``#`` comments."""
    d = files.select(key, F.posexplode(F.split("content", "\r?\n")).alias("line", "_l"))
    d = d.select(key, "line", X.strip(F.substring_index("_l", "#", 1)).alias("_v")).where("_v <> ''").withColumn("_s", F.col("_v").try_cast("double"))
    bad = F.col("_s").isNull() | F.isnan("_s") | (F.col("_s") < 0) | (F.col("_s") == float("inf"))
    d = d.withColumn("_bad", bad)
    faults = d.groupBy(key).agg(F.min(F.when(F.col("_bad"), F.col("line"))).alias("_line"))
    twice = d.where("NOT _bad").groupBy(key, "_s").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max("_n").alias("_n"))
    why = F.when(F.col("_line").isNotNull(), F.format_string("line %d: expected a finite, non-negative number", F.col("_line") + 1)).when(F.col("_n") > 1, "duplicate timestamp")
    rejects = faults.join(twice, key, "left").select(key, why.alias("reason")).where("reason IS NOT NULL")
    good = d.join(rejects.select(key), key, "left_anti")
    return good.select(key, F.round(F.col("_s") * 1000).cast("bigint").alias("at_ms")), rejects


JOB = "struct<id:string, video_path:string, status:string, needs_review:double, qc:string, log:string>"


def parse_job_export(files: DataFrame) -> DataFrame:
    """Completed jobs of an export that is a list, ``{"jobs": [...]}`` or one job."""
    raw = F.col("content")
    as_list = F.from_json(raw, f"array<{JOB}>")
    wrapped = F.from_json(raw, f"struct<jobs:array<{JOB}>>")["jobs"]
    single = F.array(F.from_json(raw, JOB))
    kind = F.when(F.ltrim(raw).startswith("["), as_list).when(F.get_json_object(raw, "$.jobs").isNotNull(), wrapped).otherwise(single)
    d = files.select("path", F.posexplode(kind).alias("ordinal", "j")).select("path", "ordinal", "j.*")
    name = F.coalesce(F.nullif("id", F.lit("")), F.nullif("video_path", F.lit("")), F.format_string("job-%08d", "ordinal"))
    return d.where("status = 'completed'").withColumn("id", name)
