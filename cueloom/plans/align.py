"""Rows that need a fold or a matcher: checked by tests, and by SQL text where recursion can say the fold."""

from pyspark.sql import functions as F

from cueloom.functions.sequence import once
from cueloom.operators import align as A
from cueloom.operators import compare as C
from cueloom.operators import layout as L
from cueloom.operators import segment as S
from cueloom.plans.compare import WIN, name_keys, tokens, windows
from cueloom.plans.registry import query
from cueloom.plans.segment import END


#: Follow `nxt`, the row that opens the next group if this one opens one, from every hard break.
FOLLOW = "g AS (SELECT media_id, i FROM n WHERE hard UNION ALL SELECT n.media_id, n.nxt FROM g JOIN n ON n.media_id = g.media_id AND n.i = g.i WHERE n.nxt IS NOT NULL)"


def closed_by(rows: str, over: str, ahead: int) -> str:
    """`n`: per row the first later one that closes its group, none beyond the next hard break; a group has fewer than `ahead` rows."""
    return f"""h AS (SELECT *, coalesce(min(CASE WHEN hard THEN i END) OVER (PARTITION BY media_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9e15::BIGINT) AS stop FROM {rows}),
n AS (SELECT a.media_id, a.i, a.hard, min(b.i) AS nxt FROM (SELECT *, unnest(range(i + 1, least(i + {ahead}, stop)::BIGINT)) AS k FROM h UNION ALL SELECT *, NULL FROM h) a LEFT JOIN h b ON b.media_id = a.media_id AND b.i = a.k AND {over} GROUP BY ALL)"""


TURNS = r"""tw AS (SELECT *, regexp_matches(text, '[.!?…][''"»)\]]*$') AS e, regexp_matches(text, '\?[''"»)\]]*$') AS q, lead(start_ms) OVER (PARTITION BY media_id ORDER BY word_idx) AS nxt, max(word_idx) OVER (PARTITION BY media_id) AS last FROM fx_words),
te AS (SELECT *, coalesce(lead(word_idx) OVER (PARTITION BY media_id ORDER BY word_idx), last) - word_idx AS reply FROM tw WHERE e),
turns AS (SELECT media_id, word_idx + 1 AS i FROM te WHERE nxt IS NOT NULL AND (nxt - end_ms >= 600 OR (nxt - end_ms >= 150 AND (q OR reply <= 2))))"""


@query("d1_acoustic_groups", f"""WITH RECURSIVE {TURNS},
r AS (SELECT w.media_id, word_idx AS i, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY w.media_id ORDER BY word_idx) AS pe, t.i IS NOT NULL AS turn FROM fx_words w LEFT JOIN turns t ON t.media_id = w.media_id AND t.i = w.word_idx),
rows1 AS (SELECT *, pe IS NULL OR start_ms - pe > 800 OR turn AS hard FROM r),
{closed_by("rows1", "b.end_ms - a.start_ms > 7000", 40)}, {FOLLOW},
o AS (SELECT r.*, lag(r.start_ms) OVER (PARTITION BY media_id ORDER BY i) AS opened FROM r JOIN g USING (media_id, i))
SELECT media_id, i AS word_idx, CASE WHEN pe IS NULL THEN 'start' WHEN start_ms - pe > 800 THEN 'real_acoustic_gap' WHEN end_ms - opened > 7000 THEN 'max_duration' ELSE 'utterance_end' END AS reason FROM o""")
def _(fx):
    return L.acoustic_groups(fx.words, S.heuristic_turns(fx.words))


def bounded(fx):
    k = (F.col("media_id") + F.col("cue_idx")) % 6
    return fx.cues.withColumn("boundary_before", F.when(k == 0, "real_acoustic_gap").when(k <= 2, "sentence_end").otherwise("display_split"))


@query("d3_split_long")
def _(fx):
    d = fx.segments.select("media_id", "seg_idx", "lang", once(F.split("text", " ")).alias("w"))
    d = d.select("media_id", "seg_idx", F.posexplode(L.split_long(F.col("w"), F.col("lang"))).alias("piece_idx", "p"))
    return d.select("media_id", "seg_idx", "piece_idx", F.array_join("p", " ").alias("text"))


@query("d4_merge_short_cues")
def _(fx):
    return L.merge_short_cues(fx.messy_cues.withColumn("boundary_before", F.lit("display_split")).withColumn("lang", F.lit("en")))


@query("d_build_cues")
def _(fx):
    return L.build_cues(fx.words).withColumn("lines", F.array_join("lines", "|"))


#: Spans of cues with the same boundaries, from hard breaks and caps of six cues and 300 characters.
SPANS = f"""bc AS (SELECT *, (media_id + cue_idx) % 6 AS k, CASE WHEN k = 0 THEN 'real' WHEN k <= 2 THEN 'sentence' ELSE 'display' END AS b FROM fx_cues),
lc AS (SELECT media_id, cue_idx AS i, start_ms, end_ms, b, length(text) AS chars, lag(end_ms) OVER w AS pe, lag(regexp_matches(trim(text), '{END}')) OVER w AS ended FROM bc WINDOW w AS (PARTITION BY media_id ORDER BY cue_idx)),
rows1 AS (SELECT *, pe IS NULL OR b = 'real' OR start_ms - pe > 2500 OR ended AS hard, sum(chars + 1) OVER (PARTITION BY media_id ORDER BY i) - chars - 1 AS held FROM lc),
{closed_by("rows1", "(b.i - a.i >= 6 OR b.held - a.held >= 300)", 8)}, {FOLLOW}"""


@query("d10_context_spans", f"WITH RECURSIVE {SPANS} SELECT media_id, i AS cue_idx FROM g")
def _(fx):
    return L.context_spans(bounded(fx))


@query("d11_merge_groups", f"""WITH RECURSIVE {SPANS},
rows2 AS (SELECT lc.media_id, lc.i, start_ms, end_ms, pe IS NULL OR b <> 'display' OR g.i IS NOT NULL AS hard FROM lc LEFT JOIN g ON g.media_id = lc.media_id AND g.i = lc.i),
{closed_by("rows2", "b.end_ms - a.start_ms > 7000", 40).replace("h AS", "h2 AS").replace("FROM h)", "FROM h2)").replace("FROM h UNION", "FROM h2 UNION").replace("JOIN h b", "JOIN h2 b").replace("n AS (", "n2 AS (", 1)},
g2 AS (SELECT media_id, i FROM n2 WHERE hard UNION ALL SELECT n2.media_id, n2.nxt FROM g2 JOIN n2 ON n2.media_id = g2.media_id AND n2.i = g2.i WHERE n2.nxt IS NOT NULL)
SELECT media_id, i AS cue_idx FROM g2""")
def _(fx):
    b = bounded(fx)
    return L.merge_groups(b, L.context_spans(b))


@query("d13_distribute_span_text")
def _(fx):
    weights = F.array(F.lit(3), (F.col("seg_idx") % 5 + 1).cast("int"), F.lit(2))
    d = fx.segments.select("media_id", "seg_idx", F.explode(L.distribute_span_text("text", weights)).alias("r"))
    return d.select("media_id", "seg_idx", "r.*")


@query("d14_layout_target")
def _(fx):
    return L.layout_target(fx.segments, ["media_id", "seg_idx"]).withColumn("lines", F.array_join("lines", "|"))


@query("g3_align_windows", f"WITH {WIN} SELECT media_id, minute, len(ref) AS ref_words, len(hyp) AS hyp_words FROM pw")
def _(fx):
    a = A.align_windows(windows(fx))
    hits = F.col("ref_words") - F.col("dels") + F.col("inss")
    return a.select("media_id", "minute", "ref_words", hits.alias("hyp_words"))


@query("g5_error_rates")
def _(fx):
    return C.error_rates(C.char_errors(A.align_windows(windows(fx))))


@query("g7_top_substitutions")
def _(fx):
    return A.top_substitutions(A.align_windows(windows(fx)), 15)


@query("g8_lyrics_coverage")
def _(fx):
    lyric = (F.col("media_id") + F.col("cue_idx")) % 9 == 0
    ref = fx.ref_cues.withColumn("text", F.when(lyric, F.concat(F.lit("♪ "), "text")).otherwise(F.col("text")))
    return A.lyrics_coverage(ref, fx.cues, tokens())


@query("g9_self_references", "SELECT video_path, arg_max(CASE WHEN id % 5 = 0 THEN 'srt_translation' ELSE 'video' END, (created_at, id)) = 'video' AS machine_made FROM fx_jobs GROUP BY 1")
def _(fx):
    j = fx.jobs.select("id", F.array("video_path").alias("outputs"), F.col("created_at").alias("finished_at"), F.when(F.col("id") % 5 == 0, "srt_translation").otherwise("video").alias("job_type"))
    return A.file_writers(j).withColumnRenamed("file", "video_path")


@query("g10_confirm_corrections", f"""WITH {WIN}, c AS (SELECT media_id, word_idx, (start_ms + end_ms) // 120000 AS m, lower(text) AS t FROM fx_words WHERE regexp_matches(text, '^[A-Z][a-z]{{3,}}$'))
SELECT c.media_id, c.word_idx, EXISTS (SELECT 1 FROM rw WHERE rw.media_id = c.media_id AND rw.minute BETWEEN c.m - 1 AND c.m + 1 AND len(list_filter(rw.t, lambda x: starts_with(x, c.t) AND length(x) - length(c.t) <= 4)) > 0) AS confirmed FROM c""")
def _(fx):
    c = fx.words.where(F.col("text").rlike("^[A-Z][a-z]{3,}$")).select("media_id", "word_idx", F.floor((F.col("start_ms") + F.col("end_ms")) / 120000).alias("minute"), F.lower("text").alias("target"))
    return A.confirm_corrections(c, C.token_windows(fx.ref_cues, tokens()), ["media_id", "word_idx"])


@query("g11_bootstrap_delta")
def _(fx):
    n, h = F.size("ref"), F.size("hyp")
    w = windows(fx).select("media_id", "minute", F.abs(n - h).alias("err_a"), n.alias("n_a"), F.greatest(n - h, F.lit(0)).alias("err_b"), n.alias("n_b"))
    return C.bootstrap_delta(w, ["media_id", "minute"])


@query("g13_bootstrap_chrf")
def _(fx):
    t = fx.translations.select("media_id", "idx", F.col("source").alias("ref"), F.col("translated").alias("hyp_a"), F.concat("source", F.lit(" x")).alias("hyp_b"))
    return C.bootstrap_chrf(t, ["media_id", "idx"])


def points(fx):
    ref = S.boundary_points(fx.ref_cues).select("media_id", F.col("at_ms").cast("bigint").alias("at_ms"))
    hyp = S.boundary_points(fx.cues).select("media_id", F.col("at_ms").cast("bigint").alias("at_ms"))
    return ref, hyp


@query("g20_match_points")
def _(fx):
    return A.match_points(*points(fx), tol_ms=400)


@query("g22_segmentation_scorecard")
def _(fx):
    return A.segmentation_scorecard(fx.cues.withColumn("lines", F.array("text")), fx.ref_cues.withColumn("lines", F.array("text")), tokens())


@query("g23_score_turns")
def _(fx):
    ref = S.boundary_points(fx.cues).where("cue_idx % 3 = 0").select("media_id", F.col("at_ms").cast("bigint").alias("at_ms"))
    return A.score_turns(S.heuristic_turns(fx.words).select("media_id", F.col("start_ms").alias("at_ms")), ref, tol_ms=350)


@query("g25_edit_counts")
def _(fx):
    return A.edit_counts(windows(fx))


def moved(fx):
    """Subtitle cues shifted, stepped or drifting against the words."""
    return fx.ref_cues


@query("g27_anchor_offsets")
def _(fx):
    return A.find_anchors(moved(fx), fx.words)


@query("g32_robust_line")
def _(fx):
    d = A.robust_line(C.drop_outliers(A.find_anchors(moved(fx), fx.words)))
    return d.select("media_id", *[F.round(c, 6).alias(c) for c in ("offset0", "slope", "spread")])


@query("g33_fit_pieces")
def _(fx):
    return A.fit_pieces(C.drop_outliers(A.find_anchors(moved(fx), fx.words)))


@query("g34_retime_report")
def _(fx):
    return A.retime(moved(fx), fx.words)[1]


@query("g34_retime_cues")
def _(fx):
    return A.retime(moved(fx), fx.words)[0]


@query("g35_align_tracks")
def _(fx):
    return C.classify_blocks(A.align_tracks(fx.cues, fx._runs(5, "cue_idx"), silence_ms=400))


@query("g39_mention_recall")
def _(fx):
    forms = name_keys(fx).select(F.col("display").alias("canonical"), F.col("display").alias("form"))
    return A.mention_recall(fx.cues, fx.ref_cues, forms)


@query("g40_blind_sample")
def _(fx):
    t = fx.translations
    return C.blind_sample(t.withColumnRenamed("source", "v"), t.withColumnRenamed("translated", "v"), ["media_id", "idx"], "v", 50)[0]
