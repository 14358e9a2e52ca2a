"""Subtitle files in and out. Parsing is row-local: one file is one row."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X
from cueloom.functions.sequence import once, scan

# Stamp patterns and the size limit of a strict source.
STAMP = r"(\d+):(\d{2}):(\d{2}),(\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2}),(\d{3})"
STAMP_LINE = rf"^{STAMP}\s*$"
LOOSE_STAMP = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
VTT_STAMP = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})(?:\s+.*)?$"
MAX_BYTES = 2 * 1024 * 1024


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) rows, one per file."""
    d = spark.read.text(paths, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def clean_content(content: Column) -> Column:
    return F.replace(F.regexp_replace(content, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))


def _times(line: Column, pattern: str) -> Column:
    """The eight numbers of a stamp line as strings, from one match; NULL where it has none."""
    return F.when(line.rlike(pattern), F.split(F.regexp_replace(line, rf"(?s)^.*?(?-s:{pattern}).*\z", "$1,$2,$3,$4,$5,$6,$7,$8"), ","))


def _millis(times: Column, first: int) -> Column:
    g = lambda i: F.coalesce(F.when(F.get(times, F.lit(i)) != "", F.get(times, F.lit(i)).cast("bigint")), F.lit(0))
    return g(first) * 3600000 + g(first + 1) * 60000 + g(first + 2) * 1000 + g(first + 3)


def _block_lines(block: Column) -> Column:
    return F.split(F.regexp_replace(block, r"^\n+|\n+$", ""), "\n")


def _cue(line: Column, pattern: str, lines: Column) -> Column:
    return X.held(_times(line, pattern), lambda at: F.struct(_millis(at, 0).alias("start_ms"), _millis(at, 4).alias("end_ms"), lines.alias("lines")))


def _exploded(files: DataFrame, cues: Column, key: str) -> DataFrame:
    d = files.select(key, F.posexplode(cues).alias("cue_idx", "_c"))
    return d.select(key, F.col("cue_idx").cast("bigint").alias("cue_idx"), "_c.start_ms", "_c.end_ms", "_c.lines", F.array_join("_c.lines", " ").alias("text"))


def parse_cues(files: DataFrame, dialect: str = "lenient", key: str = "path") -> DataFrame:
    """Cues of SRT files; malformed blocks are skipped.

    ``lenient`` wants a number line, a stamp line and text; ``reference`` takes an
    optional number line and either decimal mark.
    """
    body = files.select(key, once(clean_content(F.col("content"))).alias("_t"))
    if dialect == "lenient":
        blocks = F.transform(F.split("_t", "\n\n"), _block_lines)
        good = F.filter(blocks, lambda b: (F.size(b) >= 3) & F.get(b, F.lit(1)).rlike(STAMP))
        return _exploded(body, F.transform(good, lambda b: _cue(F.get(b, F.lit(1)), STAMP, F.slice(b, F.lit(3), F.size(b)))), key)
    blocks = F.transform(F.split(X.strip("_t"), r"(?U)\n\s*\n"), lambda b: F.filter(F.split(b, "\n"), lambda x: X.strip(x) != ""))
    # the number line is optional
    numbered = lambda b: F.when(X.strip(F.get(b, F.lit(0))).rlike(r"^\d+$"), 1).otherwise(0)
    good = F.filter(blocks, lambda b: F.coalesce(F.get(b, numbered(b)), F.lit("")).rlike(LOOSE_STAMP))

    def cue(b: Column) -> Column:
        at = numbered(b)
        text = X.strip(F.array_join(F.slice(b, at + 2, F.size(b)), " "))
        return _cue(F.get(b, at), LOOSE_STAMP, F.array(text))

    return _exploded(body, F.transform(good, cue), key)


def read_cues(spark: SparkSession, paths: str | list[str], dialect: str = "lenient") -> DataFrame:
    return parse_cues(read_files(spark, paths), dialect)


def parse_cues_strict(files: DataFrame, key: str = "path", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects): any fault rejects the whole file; empty cues are skipped.

    A file over ``max_bytes`` is a reject row; raise the argument to read larger ones.
    """
    body = files.select(key, (F.octet_length("content") > max_bytes).alias("_big"), once(clean_content(F.col("content"))).alias("_t"))
    blocks = F.filter(F.transform(F.split("_t", "\n\n"), _block_lines), lambda b: F.exists(b, lambda x: X.strip(x) != ""))

    def judged(b: Column) -> Column:
        head, stamp = X.strip(F.get(b, F.lit(0))), X.strip(F.coalesce(F.get(b, F.lit(1)), F.lit("")))
        text = X.strip(F.array_join(F.slice(b, F.lit(3), F.size(b)), "\n"))

        def row(s: Column) -> Column:
            head, start, end = s["head"], s["start"], s["end"]
            fault = (
                F.when(F.size(b) < 2, "missing timestamp line").when(~head.rlike(r"^[+-]?\d+$"), "cue number is not an integer")
                .when(~s["stamped"], "malformed timestamp line").when(end < start, "end timestamp is before start timestamp")
            )
            return X.held(fault, lambda f: F.struct(f.alias("fault"), F.when(f.isNull(), head.try_cast("bigint")).alias("number"), start.alias("start_ms"), end.alias("end_ms"), text.alias("text")))

        times = X.held(stamp, lambda s: _times(s, STAMP_LINE))
        return X.held(times, lambda at: X.held(F.struct(head.alias("head"), at.isNotNull().alias("stamped"), _millis(at, 0).alias("start"), _millis(at, 4).alias("end")), row))

    d = body.select(key, "_big", once(F.transform(blocks, judged)).alias("_b"))
    first = F.get(F.filter("_b", lambda b: b["fault"].isNotNull()), F.lit(0))["fault"]
    d = d.select(key, "_b", F.when(F.col("_big"), "file exceeds the size limit").otherwise(first).alias("fault"))
    good = d.where("fault IS NULL").select(key, F.posexplode(F.filter("_b", lambda b: b["text"] != "")).alias("cue_idx", "_c"))
    cues = good.select(key, F.col("cue_idx").cast("bigint").alias("cue_idx"), "_c.number", "_c.start_ms", "_c.end_ms", "_c.text")
    return cues, d.where("fault IS NOT NULL").select(key, "fault")


def read_cues_strict(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    return parse_cues_strict(read_files(spark, paths), max_bytes=max_bytes)


def parse_webvtt(files: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of WebVTT files: no header, notes, ids, settings or tags."""
    text = F.replace(clean_content(F.col("content")), F.lit("\r"), F.lit("\n"))
    body = files.select(key, once(F.regexp_replace(text, r"^\n+|\n+$", "")).alias("_t"))
    blocks = F.transform(F.split("_t", r"\n{2,}"), lambda b: F.split(b, "\n"))
    header = lambda b, i: (i == 0) & F.get(b, F.lit(0)).rlike(r"^WEBVTT(?:[ \t]|$)")
    note = lambda b: F.get(b, F.lit(0)).rlike(r"^(?:NOTE|STYLE|REGION)(?:[ \t]|$)") & ~F.contains(F.get(b, F.lit(0)), F.lit("-->"))
    kept = F.filter(F.filter(blocks, lambda b, i: ~header(b, i)), lambda b: F.exists(b, lambda x: X.strip(x) != "") & ~note(b))

    def judged(b: Column) -> Column:
        second = F.coalesce(F.get(b, F.lit(1)), F.lit(""))
        at = F.when(F.contains(F.get(b, F.lit(0)), F.lit("-->")), 0).when(F.contains(second, F.lit("-->")), 1)

        def row(at: Column) -> Column:
            lines = F.transform(F.slice(b, F.coalesce(at, F.lit(0)) + 2, F.size(b)), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
            stamp = F.coalesce(F.get(b, F.coalesce(at, F.lit(0))), F.lit(""))
            fault = lambda t: F.when(at.isNull(), "missing timing line").when(t.isNull(), "malformed timing line")
            return X.held(X.held(stamp, lambda s: _times(s, VTT_STAMP)), lambda t: F.struct(fault(t).alias("fault"), _millis(t, 0).alias("start_ms"), _millis(t, 4).alias("end_ms"), lines.alias("lines")))

        return X.held(at, row)

    d = body.select(key, once(F.transform(kept, judged)).alias("_b"))
    d = d.select(key, "_b", F.get(F.filter("_b", lambda b: b["fault"].isNotNull()), F.lit(0))["fault"].alias("fault"))
    rows = d.where("fault IS NULL").select(key, F.posexplode("_b").alias("cue_idx", "_c"))
    # entities are decoded in one Arrow call per batch; lines travel joined by a line break
    rows = rows.select(key, F.col("cue_idx").cast("bigint").alias("cue_idx"), "_c.start_ms", "_c.end_ms", F.array_join("_c.lines", "\n").alias("_l"))
    plain = F.transform(F.split(unescape("_l"), "\n"), lambda x: X.strip(F.replace(x, F.lit(" "), F.lit(" "))))
    cues = rows.select(key, "cue_idx", "start_ms", "end_ms", plain.alias("lines"))
    return cues.withColumn("text", F.array_join("lines", " ")), d.where("fault IS NOT NULL").select(key, "fault")


def render_cues(cues: DataFrame, key: str = "media_id") -> DataFrame:
    """File content per track: cues renumbered by start time.

    Numbers come from a block scan, so only finished blocks of text are gathered
    into the one row that is the file.
    """
    d = scan(cues, [key], "start_ms", {"_n": ("count", F.lit(1))}, ties=["cue_idx"], block=3_600_000)
    block = F.concat((F.col("_n") + 1).cast("string"), F.lit("\n"), X.srt_stamp("start_ms"), F.lit(" --> "), X.srt_stamp("end_ms"), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    d = d.select(key, F.struct("_n", block.alias("b")).alias("_s"))
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["b"]), "\n").alias("content"))


def write_cues(cues: DataFrame, path: str, key: str = "media_id") -> None:
    """One folder per track, one text file inside."""
    # the writer adds the last line break itself
    render_cues(cues, key).select(key, F.regexp_replace("content", "\n$", "").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def apply_cue_edits(cues: DataFrame, edits: DataFrame, key: str = "media_id", idx: str = "cue_idx") -> tuple[DataFrame, DataFrame]:
    """(cues, rejects): text-only edits by cue number; bad lines or numbers are rejected."""
    bad_line = F.exists("lines", lambda x: (X.strip(x) == "") | x.rlike("[\n\r]") | F.contains(x, F.lit("-->")))
    bad = (F.size("lines") == 0) | bad_line
    e = edits.select(key, idx, F.col("lines"), F.coalesce(bad, F.lit(True)).alias("_bad"))
    good = e.where("NOT _bad").select(key, idx, F.col("lines").alias("_new"))
    out = cues.join(good, [key, idx], "left").withColumn("lines", F.coalesce("_new", "lines")).drop("_new")
    unknown = good.join(cues.select(key, idx), [key, idx], "left_anti").select(key, idx, F.lit("cue index out of range").alias("reason"))
    return out, e.where("_bad").select(key, idx, F.lit("invalid cue lines").alias("reason")).unionByName(unknown)
