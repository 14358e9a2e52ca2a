"""Tracks as they come: holes in the numbering, starts above zero, words that join the previous one."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import sequence
from cueloom.operators import align, jobs, layout, prepare, segment

HOLES = [3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 40]


def words(spark, texts, idx=None, step=300, joins=None):
    idx = idx or list(range(len(texts)))
    rows = [(1, i, t, k * step, k * step + 200, "en", (joins or {}).get(k, False)) for k, (i, t) in enumerate(zip(idx, texts))]
    return spark.createDataFrame(rows, "media_id long, word_idx long, text string, start_ms long, end_ms long, lang string, joins_previous boolean")


@pytest.mark.parametrize("block", [2, 4, 8, 1000])
def test_neighbours_and_halo_at_holes(spark, block):
    d = spark.createDataFrame([(1, i, f"v{i}" if i != 16 else None) for i in HOLES], "k int, i long, v string")
    got = {r.i: (r.a, r.b, r.n) for r in sequence.neighbours(d, ["k"], "i", lag={"a": "v"}, lead={"b": "v", "n": "i"}, block=block).collect()}
    value = lambda p: None if not 0 <= p < len(HOLES) or HOLES[p] == 16 else f"v{HOLES[p]}"
    assert got == {i: (value(p - 1), value(p + 1), HOLES[p + 1] if p + 1 < len(HOLES) else None) for p, i in enumerate(HOLES)}
    spread, w, own = sequence.with_halo(d, ["k"], "i", 2, block=block)
    got = {r.i: r.p for r in spread.withColumn("p", F.lead("i", 2).over(w)).where(own).collect()}
    assert got == {i: HOLES[p + 2] if p + 2 < len(HOLES) else None for p, i in enumerate(HOLES)}


def test_groups_and_turns_of_a_track_that_starts_late(spark):
    d = words(spark, ["Yes.", "Really?", "I", "think", "so."], [5, 6, 9, 10, 12], step=1200)
    got = [(r.word_idx, r.reason) for r in layout.acoustic_groups(d).orderBy("word_idx").collect()]
    assert got == [(5, "start"), (6, "real_acoustic_gap"), (9, "real_acoustic_gap"), (10, "real_acoustic_gap"), (12, "real_acoustic_gap")]
    assert [r.word_idx for r in segment.heuristic_turns(d).orderBy("word_idx").collect()] == [6, 9]


def test_spans_and_groups_of_a_track_that_starts_late(spark):
    rows = [(1, i, k * 1000, k * 1000 + 900, t, "display_split") for k, (i, t) in enumerate([(1, "one"), (2, "two."), (5, "three"), (6, "four")])]
    cues = spark.createDataFrame(rows, "media_id long, cue_idx long, start_ms long, end_ms long, text string, boundary_before string")
    assert [r.cue_idx for r in layout.context_spans(cues).orderBy("cue_idx").collect()] == [1, 5]
    assert [r.cue_idx for r in layout.merge_groups(cues).orderBy("cue_idx").collect()] == [1]


def test_orphan_context_is_a_row_that_exists(spark):
    rows = [(1, 2, "a b c", 3, None), (1, 5, "lone", 1, "real_acoustic_gap"), (1, 9, "d e f", 3, "display_split")]
    spans = spark.createDataFrame(rows, "media_id long, span_idx long, text string, cue_count int, boundary_before string")
    assert [(r.span_idx, r.context_idx) for r in segment.orphan_spans(spans).collect()] == [(5, 2)]


def test_cues_join_tokens_as_they_were_said(spark):
    d = words(spark, ["I", "do", "n't", "know", "it", "'s", "fine", "."], joins={2: True, 7: True})
    assert [r.text for r in layout.build_cues(d).collect()] == ["I don't know it's fine."]


def test_long_sentence_is_cut_to_fit(spark):
    tokens = [f"word{i:02d}" + ("," if i == 12 else "") for i in range(40)]
    d = spark.createDataFrame([(tokens, "en")], "t array<string>, lang string")
    parts = d.select(layout.split_long(F.col("t"), F.col("lang")).alias("p")).first().p
    assert [t for p in parts for t in p] == tokens and all(len(" ".join(p)) <= layout.MAX_CHARS for p in parts)


def test_window_edits(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["a"], []), ([], []), (["colour"], ["color"]), (["one", "two"], ["two"])]
    d = spark.createDataFrame(rows, "ref array<string>, hyp array<string>")
    got = [(r.subs, r.dels, r.inss, [tuple(p) for p in r.pairs]) for r in align.align_windows(d).collect()]
    assert got == [(1, 0, 1, [("b", "x")]), (0, 0, 1, []), (0, 1, 0, []), (0, 0, 0, []), (1, 0, 0, [("colour", "color")]), (0, 1, 0, [])]


def test_recovery_leaves_other_rows_alone(spark):
    rows = [(1, "completed", 1, 500, "old"), (2, "running", 0, None, None), (3, "running", 3, None, "x")]
    d = spark.createDataFrame(rows, "id long, status string, recovery_count long, finished_at long, error_category string")
    got = {r.id: r for r in jobs.recover_orphans(d, F.lit(900).cast("bigint")).collect()}
    assert (got[1].finished_at, got[1].error_category, got[1].last_recovered_at) == (500, "old", None)
    assert (got[2].status, got[2].stage, got[2].started_at, got[2].updated_at) == ("queued", "QUEUED", None, 900)
    assert (got[3].status, got[3].progress, got[3].finished_at) == ("failed", 100, 900) and got[3].error == got[3].last_recovery_reason


def test_retry_cycles_have_no_root(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 6), (8, 99), (9, 9)]
    d = spark.createDataFrame(rows, "id long, retry_of_job_id long")
    got = {r.id: (r.root_id, r.depth) for r in jobs.retry_lineage(d).collect()}
    none = (None, None)
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: none, 6: none, 7: none, 8: (8, 0), 9: none}


def test_names_inside_unspaced_text(spark):
    schema = "media_id long, cue_idx long, start_ms long, end_ms long, text string"
    ref = spark.createDataFrame([(1, 0, 0, 1000, "東京タワーへ行く"), (1, 1, 2000, 3000, "Ａｎｎａ  Lee came"), (1, 2, 4000, 5000, "Annabel came"), (1, 3, 6000, 7000, "京です")], schema)
    own = spark.createDataFrame([(1, 0, 0, 1000, "さあ東京へ"), (1, 1, 2000, 3000, "anna lee is here"), (1, 2, 6000, 7000, "京だ")], schema)
    forms = spark.createDataFrame([("Tokyo", "東京"), ("Anna Lee", "Anna Lee"), ("Kyo", "京")], "canonical string, form string")
    got = {r.form: (r.mentions, r.exact_hit) for r in align.mention_recall(own, ref, forms).collect()}
    assert got == {"東京": (1, 1), "Anna Lee": (1, 1), "京": (1, 1)}


def test_spliced_segments_keep_their_text(spark):
    segments = spark.createDataFrame([(1, 0, 0, 20_000, 3, 1.0, "abc"), (1, 1, 30_000, 31_000, 9, 1.0, "all right")], "media_id long, seg_idx long, start_ms long, end_ms long, text_len long, compression_ratio double, text string")
    other = spark.createDataFrame([(1, 0, 0, 9_000, 40, 1.0, "x" * 40), (1, None, 25_000, 26_000, 3, 1.0, "gap")], "media_id long, span_seg_idx long, start_ms long, end_ms long, text_len long, compression_ratio double, text string")
    got = {(r.text, r.origin) for r in prepare.splice_redecodes(segments, other).collect()}
    assert got == {("x" * 40, "redecode"), ("gap", "redecode"), ("all right", "original")}
