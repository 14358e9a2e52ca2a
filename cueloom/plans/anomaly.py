"""C rows: anomalous segments."""


from pyspark.sql import functions as F

from cueloom.operators import anomaly as A
from cueloom.operators import qc as Q
from cueloom.plans.registry import query

SIGS = [("en-outro", "en", "thank you for WATCHING", "outro_boilerplate", 0.9), ("en-the", "en", r"\bthe\b", "filler", 0.2), ("fr-des", "fr", r"\bdes\b", "filler", 0.5)]


def segments(fx):
    """Segments with decoder signals as doubles and the track's running text."""
    return fx.segments.select(
        "media_id", "lang", "seg_idx", "start_ms", "end_ms", F.col("track_text").alias("text"), "compression_x10",
        (F.col("no_speech_pct") / 100).alias("no_speech_prob"), (F.col("logprob_x10") / 10).alias("avg_logprob"), (F.col("compression_x10") / 10).alias("compression_ratio"))


def signatures(fx):
    return fx.spark.createDataFrame(SIGS, "id string, language string, pattern string, category string, weight double")


BASE = r"""base AS (SELECT media_id, lang, seg_idx, start_ms, end_ms, track_text AS text, compression_x10 / 10.0::DOUBLE AS compression_ratio,
  no_speech_pct / 100.0::DOUBLE AS no_speech_prob, logprob_x10 / 10.0::DOUBLE AS avg_logprob,
  greatest(CASE WHEN lang = 'en' AND contains(lower(track_text), 'thank you for watching') THEN 0.9 ELSE 0 END,
    CASE WHEN lang = 'en' AND regexp_matches(track_text, '(?i)(^|[^\pL\pN\pM_])the($|[^\pL\pN\pM_])') THEN 0.2 ELSE 0 END,
    CASE WHEN lang = 'fr' AND regexp_matches(track_text, '(?i)(^|[^\pL\pN\pM_])des($|[^\pL\pN\pM_])') THEN 0.5 ELSE 0 END)::DOUBLE AS sig FROM fx_segments),
sg AS (SELECT *, CASE WHEN no_speech_prob >= 0.6 THEN 0.4 ELSE 0 END::DOUBLE AS ns,
  CASE WHEN compression_ratio < 2.4 THEN 0 ELSE least(1.0, 0.5 + 0.5 * (compression_ratio - 2.4) / 10.0) END::DOUBLE AS cr,
  CASE WHEN avg_logprob <= -1.0 THEN 0.3 ELSE 0 END::DOUBLE AS lp, regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g') AS nt FROM base),
rc AS (SELECT s.*, CASE WHEN len(string_split(nt, ' ')) < 3 THEN 0.0 ELSE (
    SELECT CASE WHEN count(*) < 3 THEN 0.0 ELSE 0.5 * least(1.0::DOUBLE, (count(*) - 1) / 4) + 0.5 * least(1.0::DOUBLE, ((max(o.start_ms) - min(o.start_ms)) / (SELECT max(e.end_ms) FROM base e WHERE e.media_id = s.media_id)) / 0.3::DOUBLE) END
    FROM sg o WHERE o.media_id = s.media_id AND o.nt = s.nt) END AS rec FROM sg s),
sc AS (SELECT *, CASE WHEN rec > 0 THEN CASE WHEN greatest(sig, ns, cr, lp) > 0 THEN least(1.0, greatest(sig, ns, cr, lp) + 0.3::DOUBLE * rec) ELSE 0.6::DOUBLE * rec END ELSE greatest(sig, ns, cr, lp) END AS raw FROM rc)"""


@query("c1_match_signatures", f"WITH {BASE} SELECT media_id, seg_idx, sig AS signature_score FROM base")
def _(fx):
    return A.match_signatures(segments(fx), signatures(fx)).select("media_id", "seg_idx", "signature_score")


@query("c2_decoder_signals", f"WITH {BASE} SELECT media_id, seg_idx, ns AS no_speech_score, round(cr, 6) AS compression_score, lp AS logprob_score FROM sg")
def _(fx):
    d = A.decoder_signals(segments(fx))
    return d.select("media_id", "seg_idx", "no_speech_score", F.round("compression_score", 6).alias("compression_score"), "logprob_score")


@query("c3_recurrence", f"WITH {BASE} SELECT media_id, seg_idx, round(rec, 6) AS recurrence FROM rc")
def _(fx):
    return A.recurrence_score(segments(fx)).select("media_id", "seg_idx", F.round("recurrence", 6).alias("recurrence"))


@query("c4_score_segments", f"""WITH {BASE} SELECT media_id, seg_idx, round(raw, 3) AS score, raw >= 0.75 AS suppressed,
  (CASE WHEN ns > 0 THEN 1 ELSE 0 END + CASE WHEN cr > 0 THEN 1 ELSE 0 END + CASE WHEN lp > 0 THEN 1 ELSE 0 END + CASE WHEN rec > 0 THEN 1 ELSE 0 END)::BIGINT AS signals FROM sc""")
def _(fx):
    d = A.score_segments(segments(fx), signatures(fx))
    return d.select("media_id", "seg_idx", "score", "suppressed", (F.size("reasons") - F.size("signature_ids")).cast("bigint").alias("signals"))


@query("f1_qc_transcription", f"""WITH {BASE} SELECT media_id, seg_idx AS "index", CASE WHEN raw > 0 AND raw >= 0.75 THEN 'hallucination' ELSE 'unknown' END AS category,
  CASE WHEN round(raw, 3) > 0 THEN round(raw, 3) ELSE 0.3 END AS confidence FROM sc WHERE round(raw, 3) > 0 OR avg_logprob <= -0.8""")
def _(fx):
    return Q.qc_transcription(A.score_segments(segments(fx), signatures(fx))).select("media_id", "index", "category", "confidence")




def _pct(label, where):
    picks = ", ".join(
        f"v[(least(len(v) - 1, len(v) * {num} // {den}) + 1)::BIGINT] AS {name}" for name, (num, den) in A.PERCENTILES.items())
    return f"SELECT '{label}' AS slice, len(v) AS n, {picks} FROM (SELECT list_sort(list(compression_x10)) AS v FROM fx_segments WHERE {where})"


LOOP = "length(replace(track_text, ' ', '')) >= 10 AND len(list_distinct(string_split(replace(track_text, ' ', ''), ''))) <= 0.3 * length(replace(track_text, ' ', ''))"


@query("c5_signal_percentiles", _pct("all", "true") + " UNION ALL " + _pct("loop", LOOP))
def _(fx):
    s = segments(fx)
    slices = F.array_compact(F.array(F.lit("all"), F.when(A.is_loop_shaped("text", 10, 0.3), "loop")))
    return A.signal_percentiles(s.select(F.explode(slices).alias("slice"), "compression_x10"), "compression_x10", ["slice"])


@query("c6_loop_shaped", f"SELECT media_id, seg_idx, {LOOP} AS loop_shaped FROM fx_segments")
def _(fx):
    return segments(fx).select("media_id", "seg_idx", A.is_loop_shaped("text", 10, 0.3).alias("loop_shaped"))


@query("c7_what_if", f"""WITH {BASE} SELECT media_id, seg_idx, compression_ratio FROM sc
WHERE raw < 0.75 AND greatest(round(raw, 3), CASE WHEN compression_ratio < 2.4 THEN 0 ELSE least(1.0, 0.5 + 0.5 * (compression_ratio - 2.4) / 6.0::DOUBLE) END) >= 0.75""")
def _(fx):
    return A.what_if(A.score_segments(segments(fx), signatures(fx)), 6.0).select("media_id", "seg_idx", "compression_ratio")
