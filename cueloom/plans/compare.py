"""G rows that SQL can state: comparison of two timed tracks."""

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import compare as C
from cueloom.plans.registry import query

TOK = r"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '\([^)]*\)|\[[^\]]*\]|<[^>]+>|\{{[^}}]*\}}|（[^）]*）|[♪♫]', ' ', 'g'), '[^\pL\pN_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def tokens(col="text"):
    return C.normalize_tokens(X.nfkc(col), "en")


def windows(fx):
    """Reference and hypothesis tokens per (track, minute)."""
    return C.pair_windows(C.token_windows(fx.ref_cues, tokens()), C.token_windows(fx.cues, tokens()))


WIN = f"""rw AS (SELECT media_id, (start_ms + end_ms) // 120000 AS minute, flatten(list({TOK.format('text')} ORDER BY cue_idx)) AS t FROM fx_ref_cues GROUP BY 1, 2),
hw AS (SELECT media_id, (start_ms + end_ms) // 120000 AS minute, flatten(list({TOK.format('text')} ORDER BY cue_idx)) AS t FROM fx_cues GROUP BY 1, 2),
pw AS (SELECT coalesce(r.media_id, h.media_id) AS media_id, coalesce(r.minute, h.minute) AS minute, coalesce(r.t, []) AS ref, coalesce(h.t, []) AS hyp FROM rw r FULL JOIN hw h ON r.media_id = h.media_id AND r.minute = h.minute)"""


@query("g1_normalize_tokens", f"""SELECT media_id, cue_idx, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT media_id, cue_idx, {TOK.format("'(note) ' || text || ' <i>End</i>'")} AS t FROM fx_cues)""")
def _(fx):
    t = tokens(F.concat(F.lit("(note) "), "text", F.lit(" <i>End</i>")))
    return fx.cues.select("media_id", "cue_idx", t.alias("t")).select("media_id", "cue_idx", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query("g2_token_windows", f"WITH {WIN} SELECT media_id, minute, len(t) AS n, array_to_string(t, ' ') AS tokens FROM hw")
def _(fx):
    w = C.token_windows(fx.cues, tokens())
    return w.select("media_id", "minute", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


# DuckDB counts bytes, so accented letters are mapped to one byte each first
ONE_BYTE = "translate(array_to_string({0}, ' '), 'éèàçêôùœßäöüñáíóúîâûëï¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


@query("g4_char_errors", f"""WITH {WIN} SELECT media_id, minute, levenshtein({ONE_BYTE.format('ref')}, {ONE_BYTE.format('hyp')}) AS char_errors, length(array_to_string(ref, ' ')) AS ref_chars FROM pw""")
def _(fx):
    return C.char_errors(windows(fx)).select("media_id", "minute", "char_errors", "ref_chars")


@query("g5_char_error_rate", f"""WITH {WIN}, e AS (SELECT levenshtein({ONE_BYTE.format('ref')}, {ONE_BYTE.format('hyp')}) AS ce, length(array_to_string(ref, ' ')) AS cn, len(ref) AS n, len(hyp) AS h FROM pw)
SELECT round(100.0::DOUBLE * sum(ce) / sum(cn), 6) AS cer, sum(n)::BIGINT AS ref_words, round(100.0::DOUBLE * sum(greatest(h - n, 0)) / sum(n), 6) AS extra, round(100.0::DOUBLE * sum(greatest(n - h, 0)) / sum(n), 6) AS missed FROM e""")
def _(fx):
    w = C.char_errors(windows(fx))
    n, h = F.size("ref").cast("bigint"), F.size("hyp").cast("bigint")
    zero = F.lit(0).cast("bigint")
    d = w.withColumns({"subs": zero, "dels": F.greatest(n - h, zero), "inss": F.greatest(h - n, zero), "ref_words": n})
    r = C.error_rates(d)
    return r.select(F.round("cer", 6).alias("cer"), "ref_words", F.round("extra", 6).alias("extra"), F.round("missed", 6).alias("missed"))


def name_keys(fx):
    return fx.names.select(F.lower("canonical").alias("name_key"), F.col("canonical").alias("display"), F.col("canonical").alias("name_order")).distinct()


@query("g6_name_recall", f"""WITH {WIN}, nk AS (SELECT DISTINCT lower(canonical) AS k, canonical AS d FROM fx_names),
tok AS (SELECT media_id, minute, 'r' AS side, unnest(ref) AS t, unnest(range(len(ref))) AS p FROM pw UNION ALL SELECT media_id, minute, 'h', unnest(hyp), unnest(range(len(hyp))) FROM pw),
hit AS (SELECT t.media_id, t.minute, t.side, t.p, min(nk.d) AS d FROM tok t, nk WHERE starts_with(t.t, nk.k) AND length(t.t) - length(nk.k) <= 4 GROUP BY 1, 2, 3, 4),
c AS (SELECT media_id, minute, d, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM hit GROUP BY 1, 2, 3)
SELECT d AS display, sum(r)::BIGINT AS in_reference, sum(least(r, h))::BIGINT AS found FROM c GROUP BY 1 HAVING sum(r) > 0""")
def _(fx):
    return C.name_recall(windows(fx), name_keys(fx))


@query("g7_worst_windows", f"""WITH {WIN} SELECT media_id, minute, abs(len(ref) - len(hyp)) AS errors, len(ref) AS ref_words FROM pw WHERE len(ref) >= 10
ORDER BY abs(len(ref) - len(hyp))::DOUBLE / len(ref) DESC, media_id, minute LIMIT 8""")
def _(fx):
    n, h = F.size("ref").cast("bigint"), F.size("hyp").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return C.worst_windows(windows(fx).select("media_id", "minute", zero.alias("subs"), F.greatest(n - h, zero).alias("dels"), F.greatest(h - n, zero).alias("inss"), n.alias("ref_words")))


@query("g12_chrf", """
WITH p AS (SELECT media_id, idx, replace(translated, ' ', '') AS h, replace(source, ' ', '') AS r FROM fx_translations), o AS (SELECT unnest([1,2,3,4,5,6]) AS n),
hg AS (SELECT media_id, idx, n, substr(h, i::BIGINT, n) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(h) - n + 2)) AS i FROM p, o) GROUP BY ALL),
rg AS (SELECT media_id, idx, n, substr(r, i::BIGINT, n) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM p, o) GROUP BY ALL),
m AS (SELECT n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING (media_id, idx, n, g) GROUP BY n),
s AS (SELECT n, coalesce(m, 0) / (SELECT sum(c) FROM hg WHERE hg.n = x.n) AS p, coalesce(m, 0) / (SELECT sum(c) FROM rg WHERE rg.n = x.n) AS r FROM o x LEFT JOIN m USING (n))
SELECT (SELECT count(*) FROM p) AS pairs, round(100 * 5 * avg(p) * avg(r) / (4 * avg(p) + avg(r)), 6) AS chrf FROM s""")
def _(fx):
    r = C.chrf(fx.translations, [], "translated", "source")
    return r.select("pairs", F.round("chrf", 6).alias("chrf"))


@query("g14_clean_reference", r"""SELECT media_id, cue_idx, trim(regexp_replace(regexp_replace(regexp_replace('(Eda) - ' || text || chr(10) || '- hi [door] ♪ la', '\([^)]*\)|\[[^\]]*\]|♪|♫', ' ', 'g'), '(^|\s)-\s*', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM fx_cues""")
def _(fx):
    return fx.cues.select("media_id", "cue_idx", X.clean_reference(F.concat(F.lit("(Eda) - "), "text", F.lit("\n- hi [door] ♪ la"))).alias("cleaned"))


PAIRS = r"""
pj AS (SELECT s.media_id, s.cue_idx, s.end_ms - s.start_ms AS dur, r.cue_idx AS ri, r.text, least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) AS ov
  FROM fx_cues s JOIN fx_ref_cues r ON r.media_id = s.media_id AND least(s.end_ms, r.end_ms) > greatest(s.start_ms, r.start_ms) WHERE 2 * (least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) >= r.end_ms - r.start_ms),
pg AS (SELECT media_id, cue_idx, string_agg(text, ' ' ORDER BY ri) AS raw FROM pj GROUP BY media_id, cue_idx, dur HAVING 2 * sum(ov) >= dur),
pairs AS (SELECT media_id, cue_idx, trim(regexp_replace(regexp_replace(regexp_replace(raw, '\([^)]*\)|\[[^\]]*\]|♪|♫', ' ', 'g'), '(^|\s)-\s*', ' ', 'g'), '\s+', ' ', 'g')) AS reference FROM pg WHERE NOT regexp_matches(ltrim(raw, '-( '), '^["“♪]'))"""


@query("g15_pair_cues", f"WITH {PAIRS} SELECT media_id, cue_idx, reference FROM pairs WHERE reference <> ''")
def _(fx):
    return C.pair_cues(fx.cues, fx.ref_cues)


def holes(fx):
    """Source cues whose length is cut at every fifth cue, so references stay uncovered."""
    h = (F.col("media_id") + F.col("cue_idx")) % 5
    return fx.cues.select("media_id", "cue_idx", "start_ms", F.when(h <= 2, F.col("start_ms") + 20).otherwise(F.col("end_ms")).alias("end_ms"), "text")


def spoken_refs(fx):
    h = (F.col("media_id") * 3 + F.col("cue_idx")) % 13
    t = F.when(h == 0, "♪ la la ♪").when(h == 1, "Ha ha ha...").when(h == 2, "(coughs) Ouch!").when(h == 3, "(door)").otherwise(F.col("text"))
    return fx.ref_cues.withColumn("text", t)


HOLES = """src AS (SELECT media_id, cue_idx, start_ms, CASE WHEN (media_id + cue_idx) % 5 <= 2 THEN start_ms + 20 ELSE end_ms END AS end_ms, text FROM fx_cues),
ref AS (SELECT media_id, cue_idx, start_ms, end_ms, CASE (media_id*3 + cue_idx) % 13 WHEN 0 THEN '♪ la la ♪' WHEN 1 THEN 'Ha ha ha...' WHEN 2 THEN '(coughs) Ouch!' WHEN 3 THEN '(door)' ELSE text END AS text, (media_id*3 + cue_idx) % 13 AS h FROM fx_ref_cues),
sb AS (SELECT *, unnest(range(start_ms // 60000, end_ms // 60000 + 1)) AS k FROM src),
rb AS (SELECT *, unnest(range(start_ms // 60000, end_ms // 60000 + 1)) AS k FROM ref),
ov AS (SELECT r.media_id, r.cue_idx, sum(least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) AS o FROM rb r JOIN sb s ON s.media_id = r.media_id AND s.k = r.k
  WHERE least(s.end_ms, r.end_ms) > greatest(s.start_ms, r.start_ms) AND r.k = greatest(s.start_ms // 60000, r.start_ms // 60000) GROUP BY 1, 2),
unc AS (SELECT r.* FROM ref r LEFT JOIN ov USING (media_id, cue_idx) WHERE coalesce(o, 0) < 0.1 * (r.end_ms - r.start_ms))"""

GAPS = HOLES + r""",
cl AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]|♪|♫', ' ', 'g'), '(^|\s)-\s*', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM unc),
kw AS (SELECT *, regexp_extract_all(lower(c), '[a-z]+') AS w FROM cl),
be AS (SELECT u.media_id, u.cue_idx, s.end_ms AS e FROM unc u ASOF JOIN src s ON s.media_id = u.media_id AND u.start_ms >= s.end_ms),
af AS (SELECT u.media_id, u.cue_idx, s.start_ms AS s FROM unc u ASOF JOIN src s ON s.media_id = u.media_id AND u.end_ms <= s.start_ms),
gk AS (SELECT u.media_id, u.cue_idx AS ref_idx, u.start_ms - e AS before_ms, s - u.end_ms AS after_ms, u.end_ms - u.start_ms AS dur,
  CASE WHEN c = '' OR regexp_matches(ltrim(text, '-( '), '^["“♪]') THEN 'reference_non_dialogue'
    WHEN len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('ah','aah','eh','ha','hah','heh','hmm','hm','mm','oh','uh','um'))) = 0 THEN 'reference_vocalization'
    WHEN len(w) = 1 AND w[1] IN ('ouch','ow','amen','wow','huh','hey') THEN 'brief_reference_utterance' WHEN least(u.start_ms - e, s - u.end_ms) <= 2000 THEN 'nearby_source_boundary'
    WHEN u.start_ms - e <= 5000 AND s - u.end_ms <= 5000 THEN 'between_source_cues' ELSE 'isolated_asr_gap' END AS classification
  FROM kw u LEFT JOIN be USING (media_id, cue_idx) LEFT JOIN af USING (media_id, cue_idx))"""


@query("g16_uncovered_cues", f"WITH {HOLES} SELECT media_id, cue_idx AS ref_idx, start_ms AS ref_start FROM unc")
def _(fx):
    return C.uncovered_cues(holes(fx), spoken_refs(fx)).select("media_id", "ref_idx", "ref_start")


@query("g17_classify_gaps", f"WITH {GAPS} SELECT media_id, ref_idx, classification, before_ms, after_ms FROM gk")
def _(fx):
    src = holes(fx)
    return C.classify_gaps(C.uncovered_cues(src, spoken_refs(fx)), src).select("media_id", "ref_idx", "classification", "before_ms", "after_ms")


@query("g18_gap_summary", f"WITH {GAPS} SELECT classification, count(*) AS \"count\", sum(dur)::BIGINT AS duration_ms FROM gk GROUP BY 1")
def _(fx):
    src = holes(fx)
    return C.gap_summary(C.classify_gaps(C.uncovered_cues(src, spoken_refs(fx)), src))


@query("g19_fragmentation", r"""
WITH human AS (SELECT media_id, cue_idx, start_ms, end_ms FROM fx_ref_cues WHERE NOT regexp_matches(ltrim(text, '-( '), '^["“♪]') AND trim(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]|♪|♫', ' ', 'g'), '(^|\s)-\s*', ' ', 'g'), '\s+', ' ', 'g')) <> ''),
k AS (SELECT h.media_id, h.cue_idx, count(*) AS k FROM human h JOIN fx_cues c ON c.media_id = h.media_id AND c.start_ms + c.end_ms >= 2 * h.start_ms AND c.start_ms + c.end_ms < 2 * h.end_ms GROUP BY 1, 2),
kk AS (SELECT media_id, avg(k) AS a, avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0 END) AS s FROM k GROUP BY 1),
t AS (SELECT *, length(trim(text)) <= 10 AS short, NOT regexp_matches(trim(text), '[.!?…。！？][''"」』)\]]*$') AS open, max(cue_idx) OVER (PARTITION BY media_id) AS last FROM fx_cues),
o AS (SELECT media_id, count(*) AS n, avg(CASE WHEN short THEN 1.0 ELSE 0 END) AS short_rate, count(*) FILTER (open AND cue_idx < last) AS m FROM t GROUP BY 1)
SELECT o.media_id, n AS cues, round(a, 6) AS cues_per_human_cue, round(s, 6) AS split_rate, round(short_rate, 6) AS short_rate, CASE WHEN n > 1 THEN round(m::DOUBLE / (n - 1), 6) END AS mid_sentence_rate FROM o LEFT JOIN kk USING (media_id)""")
def _(fx):
    d = C.fragmentation(fx.cues, fx.ref_cues)
    return d.select("media_id", "cues", *[F.round(c, 6).alias(c) for c in ("cues_per_human_cue", "split_rate", "short_rate", "mid_sentence_rate")])


@query("g21_precision_recall", """SELECT id, round(coalesce(tp / nullif(h, 0), 0), 6) AS precision, round(coalesce(tp / nullif(r, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(h + r, 0) , 0), 6) AS f1
FROM (SELECT id, (id % 5)::DOUBLE AS tp, CASE WHEN id % 5 = 0 THEN id % 3 ELSE id % 5 + id % 7 END AS h, CASE WHEN id % 5 = 0 THEN id % 2 ELSE id % 5 + id % 11 END AS r FROM fx_jobs)""")
def _(fx):
    k = F.col("id")
    d = fx.jobs.select("id", (k % 5).alias("tp"), F.when(k % 5 == 0, k % 3).otherwise(k % 5 + k % 7).alias("h"), F.when(k % 5 == 0, k % 2).otherwise(k % 5 + k % 11).alias("r"))
    return d.select("id", *[F.round(c, 6).alias(n) for n, c in C.prf(F.col("tp"), F.col("r"), F.col("h")).items()])


@query("g24_track_stats", """
WITH c AS (SELECT *, end_ms - start_ms AS ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY cue_idx) AS nxt FROM fx_messy_cues)
SELECT media_id, count(*) AS cue_count, round(avg(ms), 6) AS average_ms, median(ms) AS median_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (ms < 500) AS short_count,
  count(*) FILTER (nxt < end_ms) AS overlap_count, count(*) FILTER (ms > 0 AND length(text) * 1000 > 21 * ms) AS over_cps,
  count(*) FILTER (list_max(list_transform(string_split(text, '|'), lambda x: length(x))) > 42) AS over_chars, count(*) FILTER (ms > 7000) AS over_duration FROM c GROUP BY 1""")
def _(fx):
    return C.track_stats(fx.messy_cues).withColumn("average_ms", F.round("average_ms", 6))


CW = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\pL\pN_]+')"


@query("g26_timed_tokens", f"""WITH w AS (SELECT media_id, cue_idx, start_ms, end_ms, {CW.format('text')} AS w FROM fx_cues)
SELECT media_id, cue_idx, p AS pos, w[p + 1] AS token, round(start_ms + (end_ms - start_ms) * (p + 0.5::DOUBLE) / len(w), 4) AS at_ms FROM (SELECT *, unnest(range(len(w))) AS p FROM w)""")
def _(fx):
    return C.timed_tokens(fx.cues).withColumn("at_ms", F.round("at_ms", 4))


def offset_candidates(fx):
    """Cues with a known shift; every third has other words."""
    t = F.when(F.col("cue_idx") % 3 == 0, F.concat(F.lit("x "), "text")).otherwise(F.col("text"))
    s = 300 + F.col("cue_idx") % 7 * 100
    return fx.cues.select("media_id", "cue_idx", (F.col("start_ms") + s).alias("start_ms"), (F.col("end_ms") + s).alias("end_ms"), t.alias("text"))


@query("g28_cue_offsets", f"""
WITH r AS (SELECT media_id, cue_idx, start_ms, end_ms, array_to_string({CW.format('text')}, ' ') AS w FROM fx_cues),
c AS (SELECT media_id, cue_idx, start_ms + 300 + cue_idx % 7 * 100 AS start_ms, end_ms + 300 + cue_idx % 7 * 100 AS end_ms, array_to_string({CW.format("CASE WHEN cue_idx % 3 = 0 THEN 'x ' || text ELSE text END")}, ' ') AS w FROM fx_cues),
same AS (SELECT c.media_id, c.cue_idx, c.start_ms + c.end_ms - r.start_ms - r.end_ms AS d, c.start_ms + c.end_ms AS m, r.cue_idx AS ri FROM c JOIN r ON r.media_id = c.media_id AND r.w = c.w AND c.w <> ''),
ov AS (SELECT c.media_id, c.cue_idx, c.start_ms + c.end_ms - r.start_ms - r.end_ms AS d, c.start_ms + c.end_ms AS m, r.cue_idx AS ri FROM c JOIN r ON r.media_id = c.media_id AND least(c.end_ms, r.end_ms) > greatest(c.start_ms, r.start_ms)
  WHERE (c.media_id, c.cue_idx) NOT IN (SELECT (media_id, cue_idx) FROM same)),
k AS (SELECT *, row_number() OVER (PARTITION BY media_id, cue_idx ORDER BY abs(d), ri) AS n FROM (SELECT * FROM same UNION ALL SELECT * FROM ov))
SELECT media_id, cue_idx AS cand_idx, d / 2 AS offset_ms, m / 2 AS at_ms FROM k WHERE n = 1""")
def _(fx):
    return C.cue_offsets(fx.cues, offset_candidates(fx))


def offsets(fx):
    """Offset per cue: none, constant, stepped or drifting by track, plus small noise."""
    m, s = F.col("media_id") % 4, F.col("start_ms")
    base = F.when(m == 0, 0).when(m == 1, 5100).when(m == 2, F.when(s >= 60000, 5100).otherwise(0)).otherwise(F.floor(s / 200))
    return fx.cues.select("media_id", F.col("cue_idx").alias("idx"), s.alias("at_ms"), (base + F.col("cue_idx") * 37 % 41).cast("bigint").alias("offset_ms"))


OFF = "off AS (SELECT media_id, cue_idx AS idx, start_ms AS at_ms, CASE media_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5100 WHEN 2 THEN (CASE WHEN start_ms >= 60000 THEN 5100 ELSE 0 END) ELSE start_ms // 200 END + cue_idx * 37 % 41 AS offset_ms FROM fx_cues)"
RANGE = """rg AS (SELECT media_id, max(md) - min(md) AS median_range FROM (SELECT media_id, w, median(offset_ms) AS md FROM (
  SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY at_ms) - 1) // (count(*) OVER (PARTITION BY media_id) // 6) AS w, count(*) OVER (PARTITION BY media_id) AS n FROM off WHERE media_id IN (SELECT media_id FROM off GROUP BY 1 HAVING count(*) >= 60)) WHERE w < 6 GROUP BY 1, 2) GROUP BY 1)"""


@query("g29_window_median_range", f"WITH {OFF}, {RANGE} SELECT media_id, median_range FROM rg")
def _(fx):
    return C.window_median_range(offsets(fx))


@query("g30_timing_report", f"""WITH {OFF}, {RANGE}, b AS (SELECT media_id, count(*) AS n, avg(offset_ms) AS mean, median(offset_ms) AS med, stddev_pop(offset_ms) AS sd, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(offset_ms, at_ms) END AS slope, list_sort(list(offset_ms)) AS v FROM off GROUP BY 1)
SELECT media_id, n AS matched, round(mean, 6) AS mean_ms, med AS median_ms, v[((n - 1) * 95 // 100 + 1)::BIGINT] AS p95_ms, round(slope, 6) AS drift,
 CASE WHEN n < 2 THEN 'insufficient_matches' WHEN abs(slope) < 0.001 AND CASE WHEN median_range IS NOT NULL THEN median_range < 500 ELSE sd < 250 END THEN 'constant_offset' ELSE 'drift_or_nonlinear' END AS classification FROM b LEFT JOIN rg USING (media_id)""")
def _(fx):
    d = C.timing_report(offsets(fx)).drop("median_range")
    return d.withColumns({"mean_ms": F.round("mean_ms", 6), "drift": F.round("drift", 6)})


def spiky(fx):
    return offsets(fx).withColumn("offset_ms", F.col("offset_ms") + F.when((F.col("media_id") + F.col("idx") * 3) % 17 == 0, 4000).otherwise(0))


@query("g31_drop_outliers", f"""WITH {OFF}, a AS (SELECT media_id, idx, offset_ms + CASE WHEN (media_id + idx * 3) % 17 = 0 THEN 4000 ELSE 0 END AS o FROM off),
m AS (SELECT a.media_id, a.idx, a.o, (SELECT median(b.o) FROM a b WHERE b.media_id = a.media_id AND b.idx BETWEEN a.idx - 4 AND a.idx - 1) AS pre, (SELECT median(b.o) FROM a b WHERE b.media_id = a.media_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 4) AS post FROM a)
SELECT media_id, idx, o AS offset_ms FROM m WHERE (pre IS NULL AND post IS NULL) OR coalesce(abs(o - pre) <= 1000, false) OR coalesce(abs(o - post) <= 1000, false)""")
def _(fx):
    return C.drop_outliers(spiky(fx)).select("media_id", "idx", "offset_ms")


def blocks(fx):
    k = F.col("media_id") * 7 + F.col("cue_idx") * 11
    return fx.cues.select("media_id", "cue_idx", (k % 3).alias("gen_n"), F.floor(k / 3 % 3).alias("ref_n"), (k % 101 / 100).alias("lexical"), (k % 7 / 10).alias("timing"), (k % 2 == 0).alias("exact"), F.when(k % 5 == 0, k % 97 / 100).alias("semantic"))


BLOCKS = """bl AS (SELECT media_id, cue_idx, k % 3 AS g, k // 3 % 3 AS r, greatest(k % 101, CASE WHEN k % 5 = 0 THEN k % 97 ELSE 0 END) AS s, k % 7 AS t, k % 2 = 0 AS x FROM (SELECT *, media_id*7 + cue_idx*11 AS k FROM fx_cues)),
bc AS (SELECT media_id, cue_idx, CASE WHEN r = 0 THEN 'INSERTED_CONTENT' WHEN g = 0 THEN 'DROPPED_UTTERANCE' WHEN s >= 60 AND t < 2.5 THEN 'TIMING_DIFFERENCE' WHEN s >= 60 AND g * r <> 1 THEN 'SEGMENTATION_DIFFERENCE'
  WHEN s >= 60 AND x THEN 'CORRECT' WHEN s >= 60 THEN 'NORMALIZATION_DIFFERENCE' WHEN g * r <> 1 AND s >= 28 THEN 'SEGMENTATION_DIFFERENCE' WHEN s > 0 THEN 'SUBSTITUTION' ELSE 'UNKNOWN' END AS category FROM bl)"""


@query("g36_classify_blocks", f"WITH {BLOCKS} SELECT media_id, cue_idx, category FROM bc")
def _(fx):
    return C.classify_blocks(blocks(fx)).select("media_id", "cue_idx", "category")


@query("g37_summarize_alignment", f"WITH {BLOCKS} SELECT category, count(*) AS n FROM bc GROUP BY 1")
def _(fx):
    return C.summarize_alignment(C.classify_blocks(blocks(fx)))


@query("g38_compare_tracks", """SELECT media_id, count(*) FILTER ((media_id + cue_idx) % 6 > 0) AS same_timing, count(*) FILTER ((media_id + cue_idx) % 6 > 0 AND cue_idx % 4 = 0) AS text_differences FROM fx_cues GROUP BY 1 HAVING count(*) FILTER ((media_id + cue_idx) % 6 > 0) > 0""")
def _(fx):
    c = fx.cues
    moved = c.withColumns({"end_ms": F.when((F.col("media_id") + F.col("cue_idx")) % 6 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")), "text": F.when(F.col("cue_idx") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))})
    return C.compare_tracks(c, moved)


@query("g41_diff_count", "SELECT count(*) AS lines, count(*) FILTER (source <> translated) AS differing FROM fx_translations")
def _(fx):
    t = fx.translations
    return C.diff_count(t.withColumnRenamed("source", "v"), t.withColumnRenamed("translated", "v"), ["media_id", "idx"], "v")
