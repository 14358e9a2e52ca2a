"""A rows: bulk ingest and sinks. File texts are built from the given tables."""

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.plans.jobs import qc_json
from cueloom.plans.registry import query
from cueloom.sources import library as L
from cueloom.sources import records as R
from cueloom.sources import subtitles as S


def files(fx, block, head="", sep="\n"):
    """One subtitle file per track: blocks joined by a line break."""
    c = fx.cues.select("media_id", F.struct("cue_idx", block.alias("b")).alias("s"))
    d = c.groupBy("media_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]), sep).alias("c"))
    return d.select(F.col("media_id").alias("path"), F.concat(F.lit(head), "c").alias("content"))


def two_lines():
    w = F.split("text", " ")
    rest = F.array_join(F.slice(w, F.lit(2), F.size(w)), " ")
    return F.concat(F.get(w, F.lit(0)), F.when(rest == "", F.lit(" ")).otherwise(F.concat(F.lit("\n"), rest)))


def stamps(arrow=" --> "):
    return F.concat(X.srt_stamp("start_ms"), F.lit(arrow), X.srt_stamp("end_ms"))


def srt_files(fx):
    """Lenient input: BOMs, CRLF, two-line texts, broken stamps and missing texts."""
    h = (F.col("media_id") + F.col("cue_idx")) % 8
    number = (F.col("cue_idx") + 1).cast("string")
    body = F.when(h == 1, two_lines()).otherwise(F.col("text"))
    block = F.when(h == 2, F.concat(number, F.lit("\nno stamp here\n"), body, F.lit("\n"))).when(h == 3, F.concat(number, F.lit("\n"), stamps(), F.lit("\n"))).otherwise(F.concat(number, F.lit("\n"), stamps(), F.lit("\n"), body, F.lit("\n")))
    d = files(fx, block)
    m = F.col("path") % 4
    return d.select("path", F.when(m == 1, F.concat(F.lit("﻿"), "content")).when(m == 2, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content")).alias("content"))


@query("a1_lenient_cues", """SELECT media_id AS path, row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) - 1 AS cue_idx, start_ms, end_ms, CASE WHEN h = 1 AND position(' ' IN text) = 0 THEN text || ' ' ELSE text END AS text,
  CASE WHEN h = 1 AND position(' ' IN text) > 0 THEN 2 ELSE 1 END::BIGINT AS n_lines FROM (SELECT *, (media_id + cue_idx) % 8 AS h FROM fx_cues) WHERE h NOT IN (2, 3)""")
def _(fx):
    c = S.parse_cues(srt_files(fx))
    return c.select("path", "cue_idx", "start_ms", "end_ms", "text", F.size("lines").cast("bigint").alias("n_lines"))


def strict_files(fx):
    """Strict input: every seventh track has one fault; some texts are blank."""
    m, k = F.col("media_id") % 28, F.col("cue_idx")
    number = F.when((m == 7) & (k == 0), "one").otherwise((k + 1).cast("string"))
    stamp = F.when((m == 14) & (k == 0), "00:00:01 --> 00:00:02").when((m == 21) & (k == 0), "00:00:05,000 --> 00:00:04,999").otherwise(stamps())
    text = F.when(k % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("\n"), "text"))
    return files(fx, F.concat(number, F.lit("\n"), stamp, text, F.lit("\n")))


@query("a2_strict_cues", """SELECT media_id AS path, row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) - 1 AS cue_idx, cue_idx + 1 AS number, start_ms, end_ms, text FROM fx_cues
WHERE media_id % 28 NOT IN (7, 14, 21) AND cue_idx % 5 <> 4""")
def _(fx):
    return S.parse_cues_strict(strict_files(fx))[0]


@query("a2_strict_rejects", """SELECT DISTINCT media_id AS path, CASE media_id % 28 WHEN 7 THEN 'cue number is not an integer' WHEN 14 THEN 'malformed timestamp line' ELSE 'end timestamp is before start timestamp' END AS fault
FROM fx_cues WHERE media_id % 28 IN (7, 14, 21)""")
def _(fx):
    return S.parse_cues_strict(strict_files(fx))[1]


def vtt_files(fx):
    k = F.col("cue_idx")
    dot = lambda c: F.translate(X.srt_stamp(c), ",", ".")
    short = lambda c: F.when(F.col("end_ms") < 3600000, F.substring(dot(c), 4, 9)).otherwise(dot(c))
    ident = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("NOTEBOOK-1\n")).otherwise(F.concat(k.cast("string"), F.lit("\n")))
    stamp = F.when((F.col("media_id") % 30 == 11) & (k == 0), "bad").otherwise(F.concat(short("start_ms"), F.lit(" --> "), short("end_ms"), F.lit(" align:start position:0%")))
    note = F.when(k % 4 == 0, F.lit("\n\nNOTE a remark\nof two lines")).otherwise(F.lit(""))
    body = F.concat(ident, stamp, F.lit("\n<i>"), F.translate("text", "<>&", ""), F.lit("</i> &amp; &lt;b&gt;&nbsp;x"), note)
    return files(fx, body, "WEBVTT Kind: captions\n\n", "\n\n")


@query("a3_webvtt_cues", "SELECT media_id AS path, cue_idx, start_ms, end_ms, translate(text, '<>&', '') || ' & <b> x' AS text FROM fx_cues WHERE media_id % 30 <> 11")
def _(fx):
    return S.parse_webvtt(vtt_files(fx))[0].drop("lines")


@query("a3_webvtt_rejects", "SELECT DISTINCT media_id AS path, 'missing timing line' AS fault FROM fx_cues WHERE media_id % 30 = 11")
def _(fx):
    return S.parse_webvtt(vtt_files(fx))[1]


@query("a4_reference_dialect", """SELECT media_id AS path, row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) - 1 AS cue_idx, start_ms, end_ms, text FROM fx_cues WHERE cue_idx % 6 <> 5""")
def _(fx):
    k = F.col("cue_idx")
    number = F.when(k % 2 == 0, F.concat((k + 1).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    stamp = F.when(k % 6 == 5, "??").when(k % 3 == 0, F.translate(stamps(), ",", ".")).otherwise(stamps())
    return S.parse_cues(files(fx, F.concat(number, stamp, F.lit("\n"), "text", F.lit("\n \n"))), "reference").drop("lines")


def transcript_files(fx):
    """Transcript JSON per track with absent fields; some files are cut short."""
    k = F.col("seg_idx")
    word = F.struct(F.col("text").alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    seg = F.struct(k.alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.array(word).alias("words"), F.when(k % 2 == 0, F.col("compression_x10") / 10).alias("compression_ratio"), F.when(k % 3 == 0, F.lit(True)).alias("suppressed"))
    d = fx.segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", seg.alias("s")))).alias("s"))
    doc = F.struct(
        F.concat(F.lit("/tv/show"), F.col("media_id") % 9, F.lit("/"), "media_id", F.lit(".mkv")).alias("media_path"), F.md5(F.col("media_id").cast("string")).alias("media_hash"), F.lit(1).alias("audio_stream_index"), F.lit("tr").alias("language"),
        F.concat(F.lit("v"), F.col("media_id") % 3).alias("pipeline_version"), F.struct(F.lit("faster-whisper-large-v3").alias("name"), F.lit("large-v3").alias("version")).alias("asr_model"), F.transform("s", lambda x: x["s"]).alias("segments"))
    text = F.to_json(doc)
    return d.select(F.col("media_id").alias("path"), F.when(F.col("media_id") % 10 == 3, F.lit("{\"media_path\": 12, ")).otherwise(text).alias("content"))


@query("a5_transcript_segments", """SELECT media_id AS path, seg_idx, start_ms, end_ms, CASE WHEN seg_idx % 2 = 0 THEN compression_x10 / 10.0::DOUBLE ELSE 0 END::DOUBLE AS compression_ratio, seg_idx % 3 = 0 AS suppressed FROM fx_segments WHERE media_id % 10 <> 3""")
def _(fx):
    return R.transcript_segments(R.parse_transcripts(transcript_files(fx))).select("path", "seg_idx", "start_ms", "end_ms", "compression_ratio", "suppressed")


@query("a6_transcript_filter", """SELECT media_id AS path, count(*) AS words FROM fx_segments WHERE media_id % 10 <> 3 AND media_id % 9 IN (2, 5) AND media_id % 3 = 2 GROUP BY 1""")
def _(fx):
    t = R.parse_transcripts(transcript_files(fx), media_any=["/show2/", "/show5/"], version="v2")
    return R.transcript_words(R.transcript_segments(t)).groupBy("path").agg(F.count("*").alias("words"))


@query("a8_render_cues", """WITH b AS (SELECT media_id, start_ms, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_idx)) || chr(10) || list_aggregate(list_transform([start_ms, end_ms], lambda t: lpad((t // 3600000)::VARCHAR, 2, '0') || ':' || lpad((t // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((t % 1000)::VARCHAR, 3, '0')), 'string_agg', ' --> ')
  || chr(10) || replace(text, '|', chr(10)) || chr(10) AS b, cue_idx FROM fx_messy_cues) SELECT media_id, md5(string_agg(b, chr(10) ORDER BY start_ms, cue_idx)) AS content FROM b GROUP BY 1""")
def _(fx):
    return S.render_cues(fx.messy_cues).select("media_id", F.md5("content").alias("content"))


def library(fx):
    """Subtitle and video paths, one family per document."""
    m = F.col("doc_id")
    base = F.concat(F.lit("/tv/"), "source", F.lit(" {tvdb-"), F.substring("source", 4, 3), F.lit("}/S01/Show S09E99 S"), F.lpad((m % 3 + 1).cast("string"), 2, "0"), F.lit("E"), F.lpad(m.cast("string"), 3, "0"))
    tail = F.when(m % 7 == 0, ".en.hi.srt").when(m % 7 == 1, ".en.srt").when(m % 7 == 2, ".mkv").otherwise(F.concat(F.lit("."), "lang", F.lit(".srt")))
    return fx.table("documents").select(F.concat(base, tail).alias("path"), F.col("source").alias("series"))


LIB = """lb AS (SELECT source AS series, doc_id, '/tv/' || source || ' {tvdb-' || substr(source, 4, 3) || '}/S01/Show S09E99 S' || lpad((doc_id % 3 + 1)::VARCHAR, 2, '0') || 'E' || CASE WHEN length(doc_id::VARCHAR) > 3 THEN substr(doc_id::VARCHAR, 1, 3) ELSE lpad(doc_id::VARCHAR, 3, '0') END AS b,
 CASE doc_id % 7 WHEN 0 THEN '.en.hi.srt' WHEN 1 THEN '.en.srt' WHEN 2 THEN '.mkv' ELSE '.' || lang || '.srt' END AS t, CASE WHEN doc_id % 7 = 1 THEN 'en' WHEN doc_id % 7 > 2 THEN lang END AS l, doc_id % 3 + 1 AS s,
 CASE WHEN length(doc_id::VARCHAR) > 3 THEN substr(doc_id::VARCHAR, 1, 3)::INT ELSE doc_id END AS e FROM documents)"""


@query("a9_media_dimension", f"WITH {LIB} SELECT b || t AS path, l AS lang, t = '.en.hi.srt' AS variant, s AS season, e AS episode, substr(series, 4, 3)::BIGINT AS tvdb_id FROM lb")
def _(fx):
    return L.media_dimension(library(fx)).select("path", "lang", "variant", "season", "episode", "tvdb_id")


@query("a10_subtitle_coverage", """SELECT '/tv/' || (v.doc_id % 20) AS folder, 'e' || v.doc_id AS stem, v.doc_id % 3 > 0 AS has_english, CASE WHEN v.doc_id % 2 = 0 THEN 'e' || v.doc_id || '.' || 'de.srt,' ELSE '' END || 'e' || v.doc_id || '.tr.srt' AS sources FROM documents v""")
def _(fx):
    v = fx.table("documents").select("doc_id", F.concat(F.lit("/tv/"), F.col("doc_id") % 20).alias("folder"), F.concat(F.lit("e"), "doc_id").alias("stem"))
    tags = F.array_compact(F.array(F.lit("tr"), F.when(F.col("doc_id") % 3 > 0, "en"), F.when(F.col("doc_id") % 2 == 0, "de"), F.lit("en.sdh")))
    subs = v.select("folder", F.col("stem").alias("base"), F.explode(tags).alias("tag")).select("folder", "base", F.concat("base", F.lit("."), "tag", F.lit(".srt")).alias("file"))
    return L.subtitle_coverage(v.select("folder", "stem"), subs).withColumn("sources", F.array_join("sources", ","))


@query("a11_series_language", f"WITH {LIB}, n AS (SELECT series, l, count(DISTINCT s * 10000 + e) AS n FROM lb WHERE l IS NOT NULL AND l <> 'en' GROUP BY 1, 2) SELECT series, l AS lang, n AS episodes FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, l) AS r FROM n) WHERE r = 1")
def _(fx):
    lib = library(fx)
    return L.series_language(L.media_dimension(lib).join(lib, "path"))


@query("a12_match_uploads", """SELECT '/tv/' || doc_id AS folder, u AS upload, 5 AS episode FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Show S02E05.srt' WHEN 1 THEN 'Show 5. Bölüm.srt' WHEN 2 THEN 'Show Ep 5.srt' ELSE 'Show - 05.srt' END AS u FROM documents WHERE doc_id % 4 > 0 OR doc_id % 3 = 1)""")
def _(fx):
    m = F.col("doc_id")
    folder = F.concat(F.lit("/tv/"), m).alias("folder")
    name = F.when(m % 4 == 0, "Show S02E05.srt").when(m % 4 == 1, "Show 5. Bölüm.srt").when(m % 4 == 2, "Show Ep 5.srt").otherwise("Show - 05.srt")
    d = fx.table("documents")
    videos = d.select(folder, F.explode(F.array(F.concat(F.lit("Show S0"), m % 3 + 1, F.lit("E05.mkv")), F.lit("Show S01E06.mkv"))).alias("name"))
    return L.match_uploads(d.select(folder, name.alias("name")), videos).select("folder", "upload", "episode")


@query("a13_longest_prefix", """SELECT '/media/' || (o_custkey % 50) || '/' || o_orderkey || '/f.mkv' AS path, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE -(o_custkey % 50) END AS series FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey % 50 > 0""")
def _(fx):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    o = fx.table("orders")
    paths = o.select(F.concat(F.lit("/media/"), c, F.lit("/"), k, F.lit("/f.mkv")).alias("path"))
    deep = o.where(k % 5 == 0).select(F.concat(F.lit("/media/"), c, F.lit("/"), k, F.lit("/")).alias("folder"), k.alias("series"))
    top = o.where(c > 0).select(F.concat(F.lit("/media/"), c).alias("folder"), (-c).alias("series")).distinct()
    return L.join_longest_prefix(paths, deep.unionByName(top)).select("path", "series")


@query("a14_credits", """SELECT o_orderkey % 4 + 1 AS season, o_orderkey % 90 AS episode, c AS character FROM (SELECT o_orderkey, unnest(['Name ' || l_partkey, 'Alias ' || l_suppkey]) AS c, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 3 = 1 AND l_linenumber % 3 > 0 AND o_orderkey % 7 > 0)
UNION ALL SELECT NULL, NULL, unnest(['Name ' || l_partkey, 'Alias ' || l_suppkey]) FROM lineitem WHERE l_orderkey = 1 AND l_linenumber % 3 > 0""")
def _(fx):
    k = F.col("o_orderkey")
    ep = fx.table("orders").select(k.cast("string").alias("episode_id"), (F.col("o_custkey") % 3).cast("string").alias("parent"), F.when(k % 7 > 0, (k % 4 + 1).cast("string")).alias("season"), (k % 90).cast("string").alias("number"))
    n = F.col("l_linenumber") % 3
    pr = fx.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("title_id"), F.when(n == 0, "writer").when(n == 1, "actor").otherwise("actress").alias("category"),
        F.to_json(F.array(F.concat(F.lit("Name "), "l_partkey"), F.concat(F.lit("Alias "), "l_suppkey"))).alias("characters"))
    return R.credits_of(ep, pr, F.lit("1")).select(F.col("season").cast("bigint").alias("season"), F.col("episode").cast("bigint").alias("episode"), "character")


@query("a15_parse_streams", """SELECT o_orderkey AS media_id, 1 AS stream_index, CASE WHEN o_orderkey % 3 = 0 THEN 48000 END AS sample_rate, o_orderkey % 1000 * 1500 AS duration_ms, CASE WHEN o_orderkey % 4 > 0 THEN 'tur' END AS language, o_orderkey % 2 = 1 AS is_default, o_orderkey % 5 = 1 AS commentary FROM orders""")
def _(fx):
    k = F.col("o_orderkey")
    video = F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"))
    audio = F.struct(
        F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.when(k % 3 == 0, "48000").when(k % 3 == 1, "n/a").alias("sample_rate"), (k % 1000 * 1.5).cast("string").alias("duration"),
        F.struct(F.when(k % 4 > 0, "tur").alias("language")).alias("tags"), F.struct((k % 2).cast("int").alias("default"), F.when(k % 5 == 1, 1).alias("comment")).alias("disposition"))
    js = F.concat(F.lit("["), F.to_json(video), F.lit(","), F.to_json(audio), F.lit("]"))
    return R.parse_streams(fx.table("orders").select(k.alias("media_id"), js.alias("streams"))).select("media_id", "stream_index", "sample_rate", "duration_ms", "language", "is_default", "commentary")


def point_files(fx):
    k = F.col("cue_idx")
    v = F.when((F.col("media_id") % 25 == 4) & (k == 1), "soon").when((F.col("media_id") % 25 == 9) & (k == 1), "0.5").otherwise(F.format_string("%.1f", F.col("start_ms") / 1000 + 0.5))
    return files(fx, F.concat(F.when(k % 3 == 0, F.lit("# note\n\n")).otherwise(F.lit("")), v, F.lit("  # turn")))


@query("a16_points", """SELECT media_id AS path, start_ms + 500 AS at_ms FROM fx_cues c WHERE NOT (media_id % 25 IN (4, 9) AND EXISTS (SELECT 1 FROM fx_cues d WHERE d.media_id = c.media_id AND d.cue_idx = 1))""")
def _(fx):
    return R.parse_points(point_files(fx))[0]


@query("a16_point_rejects", """SELECT media_id AS path, CASE WHEN media_id % 25 = 4 THEN 'line 4: expected a finite, non-negative number' ELSE 'duplicate timestamp' END AS reason FROM fx_cues WHERE media_id % 25 IN (4, 9) AND cue_idx = 1""")
def _(fx):
    return R.parse_points(point_files(fx))[1]


@query("a17_job_export", """SELECT id::VARCHAR AS id, id % 14 AS needs_review FROM fx_jobs WHERE status = 'completed'""")
def _(fx):
    j = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "video_path", "status", "needs_review", "qc", "log"))
    m = F.col("id") % 3
    text = F.when(m == 0, j).when(m == 1, F.concat(F.lit("["), j, F.lit("]"))).otherwise(F.concat(F.lit('{"jobs": ['), j, F.lit("]}")))
    return R.parse_job_export(qc_json(fx).select(F.col("id").alias("path"), text.alias("content"))).select("id", F.col("needs_review").cast("bigint").alias("needs_review"))


def edits(fx):
    k = F.col("cue_idx")
    lines = F.when(k % 7 == 1, F.array(F.lit("new"), F.lit("text"))).when(k % 7 == 2, F.array(F.lit("a --> b"))).when(k % 7 == 3, F.array(F.lit(" "))).when(k % 7 == 4, F.array(F.lit("late")))
    return fx.cues.where(lines.isNotNull()).select("media_id", F.when(k % 7 == 4, k + 1000000).otherwise(k).alias("cue_idx"), lines.alias("lines"))


@query("a18_apply_edits", "SELECT media_id, cue_idx, CASE WHEN cue_idx % 7 = 1 THEN 'new|text' ELSE replace(text, ' ', ' ') END AS lines FROM fx_cues")
def _(fx):
    c = fx.cues.select("media_id", "cue_idx", F.array("text").alias("lines"))
    return S.apply_cue_edits(c, edits(fx))[0].select("media_id", "cue_idx", F.array_join("lines", "|").alias("lines"))


@query("a18_rejected_edits", "SELECT media_id, CASE WHEN cue_idx % 7 = 4 THEN cue_idx + 1000000 ELSE cue_idx END AS cue_idx, CASE WHEN cue_idx % 7 = 4 THEN 'cue index out of range' ELSE 'invalid cue lines' END AS reason FROM fx_cues WHERE cue_idx % 7 IN (2, 3, 4)")
def _(fx):
    c = fx.cues.select("media_id", "cue_idx", F.array("text").alias("lines"))
    return S.apply_cue_edits(c, edits(fx))[1]
