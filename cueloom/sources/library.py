"""Media-library inventory from file paths alone; no content is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variant tags and episode words.
MODIFIERS = ("hi", "sdh", "cc", "forced")
EPISODE_WORDS = "Bölüm|Bolum|Episode|Episodio|Épisode|Episódio|Folge|Ep"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def media_dimension(paths: DataFrame, column: str = "path") -> DataFrame:
    """Folder, stem, language, variant flag, last SxxEyy and series tag of each path."""
    p = F.col(column)
    name = _name(p)
    parts = F.split(F.lower(name), r"\.")
    tag = F.when(F.size(parts) >= 3, F.element_at(parts, -2))
    before = F.when(F.size(parts) >= 4, F.element_at(parts, -3))
    variant = tag.isin(*MODIFIERS) & (F.length(before).between(2, 3))
    lang = F.when(tag.rlike("^[a-z]{2,3}$") & ~F.coalesce(variant, F.lit(False)), tag)
    season = F.element_at(F.regexp_extract_all(name, F.lit(r"(?i)S(\d{1,3})E(\d{1,4})"), F.lit(1)), -1)
    episode = F.element_at(F.regexp_extract_all(name, F.lit(r"(?i)S(\d{1,3})E(\d{1,4})"), F.lit(2)), -1)
    tvdb = F.nullif(F.regexp_extract(p, r"(?i)\{tvdb-(\d+)\}", 1), F.lit(""))
    return paths.select(
        column, F.regexp_replace(p, "/[^/]*$", "").alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), lang.alias("lang"), F.coalesce(variant, F.lit(False)).alias("variant"),
        season.cast("int").alias("season"), episode.cast("int").alias("episode"), tvdb.cast("bigint").alias("tvdb_id"))


def subtitle_coverage(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Per video: an English sibling, and its source-language files.

    Subtitles carry ``base`` (name up to the first tag) and meet videos on
    (folder, stem), never by listing a folder per video.
    """
    low = F.lower("file")
    english = low.endswith(".en.srt") | low.rlike(r"\.en\.(?:hi|sdh|cc|forced)\.srt$")
    s = subtitles.select("folder", F.col("base").alias("stem"), "file", english.alias("_en"), low.endswith(".en.srt").alias("_plain"))
    j = videos.join(s, ["folder", "stem"], "left")
    return j.groupBy("folder", "stem").agg(F.coalesce(F.bool_or("_plain"), F.lit(False)).alias("has_english"), F.array_sort(F.collect_list(F.when(~F.col("_en"), F.col("file")))).alias("sources"))


def series_language(dim: DataFrame, series: str = "series") -> DataFrame:
    """Most frequent non-English language by distinct episodes; variant files do not count."""
    d = dim.where(F.col("lang").isNotNull() & (F.col("lang") != "en") & ~F.col("variant") & F.col("episode").isNotNull())
    n = d.groupBy(series, "lang").agg(F.countDistinct("season", "episode").alias("episodes"))
    tie = F.transform(F.split("lang", ""), lambda c: -F.ascii(c))
    return n.groupBy(series).agg(F.max_by(F.struct("lang", "episodes"), F.struct(F.col("episodes"), tie)).alias("_b")).select(series, "_b.*")


def episode_key(name: Column) -> Column:
    """(season or NULL, episode) guessed from a file name, or NULL."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{2,4}$", "")
    g = lambda p, i: F.nullif(F.regexp_extract(stem, p, i), F.lit("")).cast("int")
    sxe = r"(?i)S(\d{1,2})\s*E(\d{1,3})"
    before = rf"(?iu)(\d{{1,3}})\s*\.?\s*(?:{EPISODE_WORDS})(?![A-Za-z])"
    after = rf"(?iu)(?:^|[^A-Za-z])(?:{EPISODE_WORDS}|E)[\s._-]*(\d{{1,3}})(?!\d)"
    last = r"(?:^|[\s._-])(\d{1,3})$"
    ep = F.coalesce(g(sxe, 2), g(before, 1), g(after, 1), g(last, 1))
    return F.when(ep.isNotNull(), F.struct(g(sxe, 1).alias("season"), ep.alias("episode")))


def match_uploads(uploads: DataFrame, videos: DataFrame, keys: tuple[str, ...] = ("folder",)) -> DataFrame:
    """Uploads and videos of the same episode; a season counts only when both name one."""
    u = uploads.select(*keys, F.col("name").alias("upload"), episode_key(F.col("name")).alias("_u")).where("_u IS NOT NULL")
    v = videos.select(*keys, F.col("name").alias("video"), episode_key(F.col("name")).alias("_v")).where("_v IS NOT NULL")
    u = u.select(*keys, "upload", F.col("_u.season").alias("_us"), F.col("_u.episode").alias("episode"))
    v = v.select(*keys, "video", F.col("_v.season").alias("_vs"), F.col("_v.episode").alias("episode"))
    j = u.join(v, [*keys, "episode"])
    return j.where("_us IS NULL OR _vs IS NULL OR _us = _vs").select(*keys, "upload", "video", "episode")


def join_longest_prefix(paths: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """The deepest known folder that contains each path, by equi join on its ancestors."""
    clean = F.regexp_replace(path, "/+$", "")
    parts = F.split(clean, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    f = folders.withColumn("_f", F.regexp_replace(folder, "/+$", "")).where("_f <> ''")
    rest = [c for c in folders.columns]
    j = paths.select(path, F.explode(up).alias("_f")).join(f, "_f")
    return j.groupBy(path).agg(F.max_by(F.struct(*rest), F.length("_f")).alias("_b")).select(path, "_b.*")
