"""Costly steps appear once in the plan: an expression that is written twice is computed twice, or once per element of a list."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import cast, compare, entities, jobs, layout, mining, segment
from cueloom.sources import subtitles

MARK = "seen-here"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(spark, n=4):
    return spark.range(n).select(F.col("id").alias("media_id"), F.concat(F.lit("some words, and then a longer line of text "), "id").alias("text"))


def cues(spark):
    """Cues whose plan holds a mark, so that a plan tells how often they are read."""
    t = F.concat(F.lit(f"{MARK} Anna went "), F.col("id").cast("string"))
    return spark.range(4).select(F.lit(1).cast("bigint").alias("media_id"), F.col("id").alias("cue_idx"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), t.alias("text"))


def test_wrap_lines_takes_words_once(spark):
    assert plan(rows(spark).select(segment.wrap_lines(F.col("text")).alias("r"))).count("regexp_extract_all") == 1


def test_strip_affix_takes_words_once(spark):
    d = rows(spark).select(segment.strip_affix(F.concat("text", F.lit(" x")), F.col("text"), F.lit(True)).alias("r"))
    assert plan(d).count("regexp_extract_all") == 2
    assert {r.r for r in d.collect()} == {"x"}


def test_words_have_all_unicode_spaces_as_ends(spark):
    d = spark.createDataFrame([("x".join(["a", *X.SPACES, "b"]),)], "text string")
    assert d.select(F.size(X.words("text"))).first()[0] == len(X.SPACES) + 1


def test_split_long_looks_up_no_list_per_token(spark):
    d = rows(spark).select(layout.split_long(F.split("text", " "), F.lit("en")).alias("p"))
    assert plan(d).count("split(") <= 12
    assert d.first().p[0][:2] == ["some", "words,"]


def test_stamps_are_matched_once(spark):
    files = rows(spark).select(F.col("media_id").alias("path"), F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,500\n"), "text").alias("content"))
    good, bad = subtitles.parse_cues_strict(files)
    assert plan(bad).count("-->") <= 3
    assert {(r.start_ms, r.end_ms) for r in good.collect()} == {(1000, 2500)} and bad.isEmpty()
    vtt = files.select("path", F.concat(F.lit("WEBVTT\n\n00:01.000 --> 01:00:02.500 align:start\n"), F.col("content")).alias("content"))
    good, bad = subtitles.parse_webvtt(vtt.withColumn("content", F.substring_index("content", "\n1\n", 1)))
    assert plan(bad).count("(?:") <= 12
    assert plan(bad).count("regexp_extract(") == 0


def test_credits_are_parsed_once(spark):
    d = spark.createDataFrame([("Dr. Ada \"Countess\" Byron Hanım",)], "character string")
    p = cast.parse_credits(d)
    assert plan(p).count("dr.") <= 2
    assert tuple(p.select("given", "full_name", "nicknames").first()) == ("Ada", "Ada Byron", ["Countess"])


def test_cast_reads_credits_once(spark):
    p = spark.range(3).select(F.lit("s").alias("series"), F.lit("Ada").alias("given"), F.lit("Ada").alias("full_name"), F.array(F.lit("Countess")).alias("nicknames"), F.concat(F.lit(MARK), "id").alias("source"), F.lit(1).alias("season"), F.col("id").alias("episode"))
    c = cast.build_cast(p)
    assert MARK not in plan(c)
    r = c.first()
    assert (r.member, r.nicknames, len(r.sources), len(r.episodes), r.series_level) == ("ada", ["Countess"], 3, 3, False)


def test_collapse_reads_totals_once(spark):
    c = spark.range(9).select(F.lit("s").alias("series"), F.concat(F.lit(MARK), "id").alias("token"), F.col("id").alias("total"))
    assert MARK not in plan(mining.collapse_substrings(c))


def test_title_case_takes_words_once(spark):
    assert plan(rows(spark).select(mining.is_title_case("text").alias("r"))).count("regexp_extract_all") == 1


def test_repair_reads_words_once_behind_distinct_texts(spark):
    w = cues(spark).select("media_id", F.lit("s").alias("series"), "text")
    names = spark.createDataFrame([("s", "Anna", True)], "series string, name string, here boolean")
    profile = spark.createDataFrame([("s", "x", True)], "series string, folded string, ordinary boolean")
    assert plan(entities.repair_names(w, names, profile)).count(MARK) == 1


def test_rows_without_a_parent_do_not_move(spark, monkeypatch):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 99)], "id bigint, retry_of_job_id bigint")
    plans, cut = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: (plans.append(plan(df)), cut(df))[1])
    got = {tuple(r) for r in jobs.retry_lineage(d).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, 5, 0)}
    assert all("isnotnull(_p" in p or "isnotnull(retry_of" in p or "isnotnull(up" in p for p in plans)


@pytest.mark.parametrize("step", ["offsets", "gaps"])
def test_joins_read_cues_once(spark, step):
    c = cues(spark)
    if step == "offsets":
        d = compare.cue_offsets(c, c)
    else:
        d = compare.classify_gaps(compare.uncovered_cues(c.where("cue_idx > 2"), c), c)
    assert MARK not in plan(d)
