"""A7 and B rows: transcript preparation."""

from pyspark.sql import functions as F

from cueloom.operators import prepare as P
from cueloom.plans.registry import query


def raw_words(fx):
    """Decoder words: leading space marks a new word, some blanks, some zero-length."""
    i = F.col("word_idx")
    word = F.when(i % 19 == 18, F.lit("  ")).when(i % 6 == 5, F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))
    end = F.when(i % 13 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))
    return fx.words.select("media_id", "lang", (F.floor(i / 20)).alias("seg_idx"), "word_idx", word.alias("word"), "start_ms", end.alias("end_ms"))


RAW = """raw AS (SELECT media_id, lang, word_idx // 20 AS seg_idx, word_idx, CASE WHEN word_idx % 19 = 18 THEN '  ' WHEN word_idx % 6 = 5 THEN text ELSE ' ' || text END AS word,
  start_ms, CASE WHEN word_idx % 13 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM fx_words)"""


@query("a7_normalize_raw_words", f"""WITH {RAW} SELECT media_id, word_idx, trim(word) AS text, start_ms, CASE WHEN end_ms < start_ms + 10 THEN start_ms + 10 ELSE end_ms END AS end_ms,
  substr(word, 1, 1) <> ' ' AS joins_previous FROM raw WHERE trim(word) <> ''""")
def _(fx):
    return P.normalize_raw_words(raw_words(fx)).select("media_id", "word_idx", "text", "start_ms", "end_ms", "joins_previous")


@query("b1_render_words", f"""WITH {RAW}, k AS (SELECT * FROM raw WHERE trim(word) <> '')
SELECT media_id, seg_idx, trim(string_agg(CASE WHEN regexp_matches(trim(word), '^[''’][\\pL\\pN\\pM_]') THEN trim(word) ELSE word END, '' ORDER BY word_idx)) AS text FROM k GROUP BY 1, 2""".replace("\\\\", "\\"))
def _(fx):
    return P.render_words(P.normalize_raw_words(raw_words(fx)), ["media_id", "seg_idx"])


def gappy(fx):
    """Segments with planted holes, long sparse stretches and loops."""
    s = fx.segments
    h = (s.media_id + s.seg_idx) % 9
    return s.select(
        "media_id", "lang", "seg_idx", "start_ms",
        F.when(h == 4, F.col("start_ms") + 500).when(h == 7, F.col("end_ms") + 9000).when(h == 2, F.col("end_ms") + 2500).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(h == 7, 12).when(h == 2, 9).otherwise(F.length("text")).cast("bigint").alias("text_len"),
        (F.col("compression_x10") / 10).alias("compression_ratio"), "no_speech_pct", "logprob_x10", "text")


GAPPY = """g AS (SELECT media_id, lang, seg_idx, start_ms, CASE h WHEN 4 THEN start_ms + 500 WHEN 7 THEN end_ms + 9000 WHEN 2 THEN end_ms + 2500 ELSE end_ms END AS end_ms,
  CASE h WHEN 7 THEN 12 WHEN 2 THEN 9 ELSE length(text) END AS text_len, compression_x10, text FROM (SELECT *, (media_id + seg_idx) % 9 AS h FROM fx_segments))"""


@query("b2_coverage_gaps", f"""WITH {GAPPY}, d AS (SELECT DISTINCT doc_id AS media_id, 60000 * (1 + doc_id % 12) AS duration_ms FROM documents),
p AS (SELECT media_id, start_ms, greatest(coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS prev FROM g)
SELECT media_id, prev AS gap_start_ms, start_ms AS gap_end_ms FROM p WHERE start_ms - prev >= 5000
UNION ALL SELECT d.media_id, coalesce(max(g.end_ms), 0), d.duration_ms FROM d LEFT JOIN g USING (media_id) GROUP BY d.media_id, d.duration_ms HAVING d.duration_ms - coalesce(max(g.end_ms), 0) >= 5000""")
def _(fx):
    durations = fx.table("documents").select(F.col("doc_id").alias("media_id"), (60000 * (1 + F.col("doc_id") % 12)).alias("duration_ms"))
    return P.coverage_gaps(gappy(fx), durations, min_ms=5000)


LOOPY = "(end_ms - start_ms >= 10000 AND compression_x10 >= 74)"
SPARSE = "(end_ms - start_ms >= 10000 AND CASE WHEN end_ms - start_ms < 15000 THEN text_len * 1000 <= end_ms - start_ms ELSE text_len * 1000 <= 2.5 * (end_ms - start_ms) END)"


@query("b3_sparse_segments", f"WITH {GAPPY} SELECT media_id, seg_idx FROM g WHERE {SPARSE} AND NOT {LOOPY}")
def _(fx):
    return P.sparse_segments(gappy(fx)).select("media_id", "seg_idx")


@query("b4_loop_segments", f"WITH {GAPPY} SELECT media_id, seg_idx FROM g WHERE {LOOPY}")
def _(fx):
    return P.loop_segments(gappy(fx)).select("media_id", "seg_idx")


@query("b5_splice_redecodes", f"""
WITH {GAPPY}, alt AS (SELECT media_id, CASE WHEN seg_idx % 10 = 0 THEN NULL ELSE seg_idx END AS span, start_ms + 1000 * v AS start_ms, start_ms + 1000 * v + 900 AS end_ms,
  (seg_idx * 7 + v * 5) % 23 AS text_len, 10 + (seg_idx * 3 + v) % 16 AS c10 FROM g, (VALUES (0), (1)) t(v)),
k AS (SELECT g.*, CASE WHEN {LOOPY} THEN coalesce((SELECT bool_and(a.text_len > 0 AND a.c10 < 24) FROM alt a WHERE a.media_id = g.media_id AND a.span = g.seg_idx), false)
  WHEN {SPARSE} THEN coalesce((SELECT sum(a.text_len) FROM alt a WHERE a.media_id = g.media_id AND a.span = g.seg_idx), 0) > text_len ELSE false END AS take FROM g)
SELECT media_id, start_ms, end_ms, text_len::BIGINT AS text_len, 'original' AS origin FROM k WHERE NOT take
UNION ALL SELECT a.media_id, a.start_ms, a.end_ms, a.text_len, 'redecode' FROM alt a JOIN k ON k.media_id = a.media_id AND k.seg_idx = a.span WHERE k.take
UNION ALL SELECT media_id, start_ms, end_ms, text_len, 'redecode' FROM alt WHERE span IS NULL""")
def _(fx):
    g = gappy(fx)
    a = g.select("media_id", "seg_idx", "start_ms", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    start = F.col("start_ms") + 1000 * F.col("v")
    alt = a.select(
        "media_id", F.when(F.col("seg_idx") % 10 != 0, F.col("seg_idx")).alias("span_seg_idx"), start.alias("start_ms"), (start + 900).alias("end_ms"),
        ((F.col("seg_idx") * 7 + F.col("v") * 5) % 23).alias("text_len"), ((10 + (F.col("seg_idx") * 3 + F.col("v")) % 16) / 10).alias("compression_ratio"))
    return P.splice_redecodes(g, alt).select("media_id", "start_ms", "end_ms", "text_len", "origin")


@query("b6_majority_language", """
WITH v AS (SELECT media_id, CASE (media_id * 3 + seg_idx * 5) % 7 WHEN 0 THEN 'tr' WHEN 1 THEN 'tr' WHEN 2 THEN 'en' WHEN 3 THEN 'en' WHEN 4 THEN 'ja' END AS l, no_speech_pct AS c FROM fx_segments),
p AS (SELECT media_id, l, count(*) AS n, sum(c) AS s FROM v WHERE l IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY media_id) AS a, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, s * 1.0 / n DESC, l) AS k FROM p)
SELECT media_id, l AS lang, round((s / 100.0::DOUBLE) / a + 1e-9, 6) AS probability FROM r WHERE k = 1""")
def _(fx):
    h = (F.col("media_id") * 3 + F.col("seg_idx") * 5) % 7
    lang = F.when(h <= 1, "tr").when(h <= 3, "en").when(h == 4, "ja")
    v = fx.segments.select("media_id", lang.alias("lang"), (F.col("no_speech_pct") / 100).alias("confidence"))
    return P.majority_language(v).select("media_id", "lang", F.round(F.col("probability") + 1e-9, 6).alias("probability"))


def transcripts(fx):
    """Job-like transcript headers: several versions per media path."""
    k = F.col("id")
    return fx.jobs.select(
        "id", "video_path", (F.col("created_at") + k % 86400).alias("created_at"), F.md5("video_path").alias("media_hash"), (k % 3).alias("audio_stream_index"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("pipeline_version"), F.when(k % 5 == 0, "small").otherwise("large-v3").alias("model"))


TRANSCRIPTS = """tr AS (SELECT id, video_path, created_at + id % 86400 AS created_at, md5(video_path) AS media_hash, id % 3 AS audio_stream_index, 'v' || (id % 4) AS pipeline_version,
  CASE WHEN id % 5 = 0 THEN 'small' ELSE 'large-v3' END AS model FROM fx_jobs)"""


@query("b7_latest_transcript", f"""WITH {TRANSCRIPTS} SELECT video_path, id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY created_at DESC, id DESC) AS r FROM tr WHERE model = 'large-v3') WHERE r = 1""")
def _(fx):
    return P.latest_by(transcripts(fx).where("model = 'large-v3'").select("video_path", "id", "created_at"), ["video_path"], "created_at", ["id"])


@query("b8_provenance_key", f"""WITH {TRANSCRIPTS} SELECT id, sha256('{{"alignment_model": null, "asr_model": {{"name": "faster-whisper-' || model || '", "version": "' || model || '"}}, "audio_stream_index": ' || audio_stream_index ||
 ', "language": "tr", "media_hash": "' || media_hash || '", "pipeline_version": "' || pipeline_version || '", "stream_codec": "aac"}}') AS cache_key FROM tr""")
def _(fx):
    fields = {
        "media_hash": F.col("media_hash"), "audio_stream_index": F.col("audio_stream_index"), "stream_codec": "aac", "language": "tr",
        "asr_model": {"name": F.concat(F.lit("faster-whisper-"), "model"), "version": F.col("model")}, "alignment_model": F.lit(None).cast("string"), "pipeline_version": F.col("pipeline_version"),
    }
    return transcripts(fx).select("id", P.provenance_key(fields).alias("cache_key"))


@query("b9_validate_hits", f"""WITH {TRANSCRIPTS} SELECT r.id AS request_id, c.media_hash, r.media_hash = c.media_hash AND r.audio_stream_index = c.audio_stream_index AND r.pipeline_version = c.pipeline_version
  AND r.model = CASE WHEN c.id % 5 = 0 THEN 'small' ELSE 'large-v3' END AS valid FROM tr r JOIN tr c ON c.id = r.id * 3""")
def _(fx):
    t = transcripts(fx)
    req = t.select(F.col("id").alias("request_id"), (F.col("id") * 3).alias("cache_key"), "media_hash", "audio_stream_index", "pipeline_version", F.col("model").alias("model_name"))
    have = t.select(F.col("id").alias("cache_key"), "media_hash", "audio_stream_index", "pipeline_version", F.concat(F.lit("faster-whisper-"), "model").alias("model_name"))
    return P.validate_hits(req, have)


RULES = (
    P.WordRule("en-colour", "en", r"\bthe\b", "la", confidence=0.9),
    P.WordRule("en-weak", "en", r"\band\b", "und", confidence=0.5),
    P.WordRule("fr-le", "fr", r"\ble\b", "lo", confidence=1.0),
)


@query("b10_word_rules", r"""
WITH m AS (SELECT *, CASE WHEN lang = 'en' THEN 'the' WHEN lang = 'fr' THEN 'le' END AS w, CASE WHEN lang = 'en' THEN 'la' WHEN lang = 'fr' THEN 'lo' END AS r FROM fx_words),
x AS (SELECT *, (lang = 'en' AND regexp_matches(text, '(?i)(^|[^\pL\pN\pM_])the($|[^\pL\pN\pM_])')) OR (lang = 'fr' AND regexp_matches(text, '(?i)(^|[^\pL\pN\pM_])le($|[^\pL\pN\pM_])')) AS hit FROM m),
y AS (SELECT *, CASE WHEN hit AND lang = 'en' THEN regexp_extract(text, '(?i)the') WHEN hit THEN regexp_extract(text, '(?i)le') END AS f FROM x)
SELECT media_id, word_idx, CASE WHEN hit IS NOT TRUE THEN text ELSE replace(text, f, CASE WHEN f = upper(f) THEN upper(r) WHEN substr(f, 1, 1) = upper(substr(f, 1, 1)) THEN upper(substr(r, 1, 1)) || substr(r, 2) ELSE r END) END AS text,
  CASE WHEN hit THEN 1 ELSE 0 END::BIGINT AS corrections FROM y""")
def _(fx):
    w = P.apply_word_rules(fx.words, RULES)
    return w.select("media_id", "word_idx", "text", F.size("corrections").cast("bigint").alias("corrections"))


@query("b11_live_words", """SELECT w.media_id, count(*) AS words FROM fx_words w JOIN fx_segments s ON s.media_id = w.media_id AND s.seg_idx = w.word_idx // 20 WHERE s.no_speech_pct < 80 GROUP BY 1""")
def _(fx):
    segs = fx.segments.select("media_id", "seg_idx", (F.col("no_speech_pct") >= 80).alias("suppressed"))
    w = fx.words.withColumn("seg_idx", F.floor(F.col("word_idx") / 20))
    return P.live_words(w, segs).groupBy("media_id").agg(F.count("*").alias("words"))


@query("b12_uncertain_language", "SELECT id, CASE WHEN id % 3 = 0 THEN 'MANUAL' ELSE 'AUTO' END = 'AUTO' AND id % 11 > 0 AND id % 100 < 50 AS uncertain FROM fx_jobs")
def _(fx):
    k = F.col("id")
    return fx.jobs.select("id", P.uncertain_language(F.when(k % 3 == 0, "MANUAL").otherwise("AUTO"), F.when(k % 11 > 0, (k % 100) / 100)).alias("uncertain"))


def streams(fx):
    """Audio streams per order: one per line item number."""
    li = fx.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (h % len(v) + 1).cast("int"))
    s = li.select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("bigint").alias("stream_index"), pick("Main", "Director Commentary", None, "Stereo", "SDH mix").alias("title"),
        F.lit(None).cast("string").alias("handler_name"), pick("tur", "eng", "fr", None).alias("language"), (h % 3 == 0).alias("is_default"), (h % 11 == 0).alias("commentary"),
        F.lit(False).alias("visual_impaired"), (h % 13 == 0).alias("hearing_impaired"), (h % 3 + 1).alias("channels"), (h % 100).alias("duration_ms"), F.lit(90).cast("bigint").alias("total_ms"))
    p = li.where((F.col("l_orderkey") + F.col("l_linenumber")) % 6 > 0).select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("bigint").alias("stream_index"), pick("tr", "en", "fr").alias("detected"), (h % 101 / 100).alias("confidence"))
    return s, p


@query("b13_rank_streams", """
WITH li AS (SELECT DISTINCT l_orderkey AS media_id, l_linenumber::BIGINT AS stream_index, l_orderkey * 7 + l_linenumber * 5 AS h FROM lineitem),
s AS (SELECT *, CASE h % 5 WHEN 1 THEN 'director commentary' WHEN 4 THEN 'sdh mix' ELSE '' END AS t, CASE h % 4 WHEN 0 THEN 'tr' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS own,
  CASE WHEN (media_id + stream_index) % 6 > 0 THEN CASE h % 3 WHEN 0 THEN 'tr' WHEN 1 THEN 'en' ELSE 'fr' END END AS detected, CASE WHEN (media_id + stream_index) % 6 > 0 THEN h % 101 END AS c FROM li),
x AS (SELECT *, h % 11 = 0 OR h % 13 = 0 OR t <> '' AS out, coalesce(0.45::DOUBLE * (c / 100.0::DOUBLE), 0) + CASE WHEN h % 3 = 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN own = detected THEN 0.15 ELSE 0 END::DOUBLE
   + CASE WHEN h % 3 + 1 >= 2 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN h % 100 >= 81 THEN 0.05 ELSE 0 END::DOUBLE AS score FROM s),
k AS (SELECT * FROM (SELECT *, bool_and(out) OVER (PARTITION BY media_id) AS allout FROM x) WHERE NOT out OR allout),
r AS (SELECT *, row_number() OVER w AS rank, first(score) OVER w AS best FROM k WINDOW w AS (PARTITION BY media_id ORDER BY CASE WHEN detected = 'tr' THEN 0 ELSE 1 END, score DESC, stream_index))
SELECT media_id, stream_index, detected, round(score, 6) AS score, rank, rank > 1 AND best - score <= 0.15 AS alternate FROM r""")
def _(fx):
    s, p = streams(fx)
    return P.rank_streams(s, p, "tur").withColumn("score", F.round("score", 6))


@query("b14_normalize_lang", """SELECT DISTINCT l AS code, CASE WHEN l = '' THEN NULL WHEN lower(l) = 'eng' THEN 'en' WHEN lower(l) = 'ger' THEN 'de' WHEN length(l) = 2 THEN lower(l) ELSE substr(lower(l), 1, 2) END AS lang
FROM (SELECT CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'ENG' WHEN 2 THEN '' WHEN 3 THEN 'ger' ELSE upper(source) END AS l FROM documents)""")
def _(fx):
    m = F.col("doc_id") % 5
    code = F.when(m == 0, F.col("lang")).when(m == 1, "ENG").when(m == 2, "").when(m == 3, "ger").otherwise(F.upper("source"))
    return fx.table("documents").select(code.alias("code")).distinct().select("code", P.normalize_lang("code").alias("lang"))
